"""Inference: what a scan of a repository skips, clusters of documents, pattern tallies, shared sections, proposed rules."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.globs import escape_glob, matches
from corpusloom.functions.patterns import check
from corpusloom.functions.scalars import candidates, dirname, file_part, has_scheme
from corpusloom.operators import primitives as p
from corpusloom.sources.corpus import Corpus
from corpusloom.sources.listing import NOISE

#: Folder names that make a cluster with a single document.
CLUSTER_NAMES = ("docs", "documentation", "doc", "specs", "spec", "adr", "rfc", "rfcs", "references", "reference", "guides")
#: The sections of decision records; a document counts as one with two of the first three.
CORE_SECTIONS, MORE_SECTIONS = ("status", "context", "decision"), ("consequences", "alternatives")
CORE_LEAST = 2
MIN_DOCUMENTS = 3
SAMPLE = 5
#: The least cycle that GRP-001 reports by default.
MIN_CYCLE = 3
#: What a scan takes for documents, and its glob.
MARKDOWN, SUFFIX = r"[^/]\.mdx?$", "*.{md,mdx}"


def ancestors(path: Column) -> Column:
    """All folders above a path, nearest last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def folder_counts(paths: DataFrame) -> DataFrame:
    """dir, documents: Markdown files anywhere below each folder."""
    below = paths.where(F.col("path").contains("/")).select(F.explode(ancestors(F.col("path"))).alias("dir"))
    return below.groupBy("dir").agg(F.count("*").alias("documents"))


@dataclass
class Scan:
    """clusters; pruned: path, reason (noise, gitignored, hidden), documents (hidden ones only); paths: what was scanned."""

    clusters: DataFrame
    pruned: DataFrame
    paths: DataFrame


def scan_repository(files: DataFrame, ignored: DataFrame | None = None, packages: tuple[str, ...] = (), names: tuple[str, ...] = CLUSTER_NAMES, least: int = MIN_DOCUMENTS, sample: int = SAMPLE, noise: tuple[str, ...] = NOISE) -> Scan:
    """files(path): everything of a repository; ignored(path): files and folders that ignore files name.

    A walk from the root would skip a folder as noise, else as ignored, else as hidden, and not go on below it: of a path's
    folders the outermost such one counts. Hidden folders tell how many documents they hold outside noise and ignored ones.
    """
    folders = F.when(F.col("path").contains("/"), ancestors(F.col("path"))).otherwise(F.array().cast("array<string>"))
    df = files.select("path").distinct().withColumn("folders", folders)
    if ignored is None:
        df = df.withColumn("out", F.array().cast("array<string>"))
    else:  # a semi-join of prefixes; only paths with an ignored one take part in the grouping
        prefixes = df.select("path", F.explode(F.concat("folders", F.array("path"))).alias("prefix"))
        hit = prefixes.join(ignored.select(F.col("path").alias("prefix")).distinct(), "prefix", "left_semi").groupBy("path").agg(F.collect_set("prefix").alias("out"))
        df = df.join(hit, "path", "left").withColumn("out", F.coalesce("out", F.array().cast("array<string>")))
    name = lambda d: F.element_at(F.split(d, "/"), -1)
    reason = lambda d: F.when(name(d).isin(list(noise)), "noise").when(F.array_contains("out", d), "gitignored").when(name(d).startswith("."), "hidden")
    why = F.filter(F.transform("folders", lambda d: F.struct(d.alias("path"), reason(d).alias("reason"))), lambda x: x["reason"].isNotNull())
    df = df.withColumn("why", why).withColumn("document", F.col("path").rlike(MARKDOWN) & ~F.array_contains("out", F.col("path")))
    counted = F.col("document") & ~F.exists("why", lambda x: x["reason"] != "hidden")
    skipped = df.where(F.size("why") > 0).select(F.col("why")[0]["path"].alias("path"), F.col("why")[0]["reason"].alias("reason"), counted.cast("long").alias("n"))
    pruned = skipped.groupBy("path", "reason").agg(F.sum("n").alias("n")).select("path", "reason", F.when(F.col("reason") == "hidden", F.col("n")).alias("documents"))
    paths = df.where(F.col("document") & (F.size("why") == 0)).select("path")
    return Scan(clusters(paths, names, least, sample, packages), pruned, paths)


def clusters(paths: DataFrame, names: tuple[str, ...] = CLUSTER_NAMES, least: int = MIN_DOCUMENTS, sample: int = SAMPLE, packages: tuple[str, ...] = ()) -> DataFrame:
    """path, kind (cluster, root, fallback), score, documents, include, samples, package.

    A file belongs to the deepest workspace package above it, or to the root. Below that, a folder qualifies with `least`
    documents under it, or with one and a known name, which adds `least` to its score; of nested ones the topmost stays.
    Files directly in a package or in the root form a cluster of kind root. If nothing qualifies anywhere, all files are one.
    """
    folders = F.when(F.col("path").contains("/"), ancestors(F.col("path"))).otherwise(F.array().cast("array<string>"))
    own = F.filter("folders", lambda d: d.isin(list(packages)))
    member = paths.select(F.col("path").alias("file"), folders.alias("folders")).withColumn("package", F.coalesce(F.get(F.reverse(own), F.lit(0)), F.lit("")))
    member = member.select("file", "package", F.explode(F.concat(F.array("package"), F.filter("folders", lambda d: F.length(d) > F.length("package")))).alias("path"), F.element_at(F.concat(F.array(F.lit("")), "folders"), -1).alias("folder"))
    counts = member.groupBy("package", "path").agg(F.count("*").alias("documents"), F.count_if(F.col("folder") == F.col("path")).alias("direct"))
    known = F.lower(F.element_at(F.split("path", "/"), -1)).isin([n.lower() for n in names])
    fit = counts.where((F.col("path") != F.col("package")) & (known | (F.col("documents") >= least))).withColumn("known", known)
    above = fit.select("package", "path", F.explode(F.filter(ancestors(F.concat("path", F.lit("/x"))), lambda d: d != F.col("path"))).alias("up"))
    nested = above.join(fit.select("package", F.col("path").alias("up")), ["package", "up"], "left_semi").select("package", "path").distinct()
    top = fit.join(nested, ["package", "path"], "left_anti").select("package", "path", F.lit("cluster").alias("kind"), (F.col("documents") + F.when(F.col("known"), least).otherwise(0)).alias("score"), "documents", F.concat(escape_glob(F.col("path")), F.lit(f"/**/{SUFFIX}")).alias("include"))
    inside = F.when(F.col("path") == "", f"./{SUFFIX}").otherwise(F.concat(escape_glob(F.col("path")), F.lit(f"/{SUFFIX}")))
    root = counts.where((F.col("path") == F.col("package")) & (F.col("direct") > 0)).select("package", "path", F.lit("root").alias("kind"), F.col("direct").alias("score"), F.col("direct").alias("documents"), inside.alias("include"))
    found = top.unionByName(root)
    shown = member.join(found.select("package", "path", "kind"), ["package", "path"]).where("kind = 'cluster' or folder = path")
    first = shown.withColumn("k", F.row_number().over(W.partitionBy("package", "path").orderBy("file"))).where(F.col("k") <= sample)
    samples = first.groupBy("package", "path").agg(F.array_sort(F.collect_list("file")).alias("samples"))
    # One row at most: the fallback, where no other cluster is.
    few = F.slice(F.array_sort(F.collect_list("path")), 1, sample)
    least_paths = paths.orderBy("path").limit(sample).agg(few.alias("samples"))
    every = paths.agg(F.count("*").alias("documents")).where("documents > 0").join(found.agg(F.count("*").alias("clusters")).where("clusters = 0")).join(least_paths)
    fallback = every.select(F.lit("").alias("package"), F.lit("").alias("path"), F.lit("fallback").alias("kind"), F.col("documents").alias("score"), "documents", F.lit("**/*.md").alias("include"), "samples")
    out = found.join(samples, ["package", "path"]).unionByName(fallback)
    rank = F.when(F.col("kind") == "cluster", 0).when(F.col("kind") == "root", 1).otherwise(2)
    return out.select("path", "kind", "score", "documents", "include", "samples", F.nullif("package", F.lit("")).alias("package")).orderBy(rank, F.desc("score"), "path")


def tally(documents: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """documents: cluster, content. cluster, pattern, n: documents in which each pattern occurs. One pass for all patterns."""
    hits = F.array_compact(F.array(*[F.when(F.col("content").rlike(check(rx)), F.lit(name)) for name, rx in patterns.items()]))
    return documents.select("cluster", F.explode(hits).alias("pattern")).groupBy("cluster", "pattern").agg(F.count("*").alias("n"))


def shared_headings(headings: DataFrame, least: int = 2) -> DataFrame:
    """headings: cluster, path, pos, text. Texts that every document of a cluster (of at least `least`) has, in the first one's order."""
    sizes = headings.groupBy("cluster").agg(F.count_distinct("path").alias("documents")).where(F.col("documents") >= least)
    often = headings.groupBy("cluster", "text").agg(F.count_distinct("path").alias("n"), F.min_by("pos", F.struct("path", "pos")).alias("pos"))
    return often.join(sizes, "cluster").where("n = documents").select("cluster", "text", "pos")


def pattern_counts(corpus: Corpus) -> DataFrame:
    """path, pattern, n: what each document holds of what rules look at; one row for each document and pattern."""
    part = lambda x: file_part(x["raw_target"]) != ""
    anchored = lambda x: F.coalesce(x["anchor"], F.lit("")) != ""
    local = F.filter("links", lambda x: (x["kind"] == "local-file") & part(x))
    anchors = F.filter("links", lambda x: anchored(x) & (((x["kind"] == "local-file") & part(x)) | (x["kind"] == "same-file-anchor")))
    images = F.filter("images", lambda x: part(x) & ~has_scheme(x["raw_target"]))
    sizes = {"localLinks": local, "anchorLinks": anchors, "images": images, "tables": F.col("tables"), "checklistItems": F.col("check_items")}
    pairs = F.array(*[F.struct(F.lit(k).alias("pattern"), F.size(v).cast("long").alias("n")) for k, v in sizes.items()])
    held = corpus.documents.select("path", F.explode(pairs).alias("x")).select("path", "x.*")
    empty = p.no_placeholders(corpus.section_bodies).groupBy("path").agg(F.count("*").alias("n")).select("path", F.lit("placeholderSections").alias("pattern"), "n")
    return held.unionByName(empty)


def tally_totals(counts: DataFrame) -> DataFrame:
    """counts: cluster, path, pattern, n. pattern, cluster (null: all clusters), n, documents that hold any: one rollup."""
    rolled = counts.rollup("pattern", "cluster").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("documents"), F.grouping_id().alias("level"))
    return rolled.where("level < 3").select("pattern", "cluster", "n", "documents")


def decision_sections(headings: DataFrame, documents: DataFrame) -> DataFrame:
    """headings: cluster, path, pos, text; documents: cluster, path. cluster, text, pos: what all decision records of a cluster share.

    Only clusters each of whose documents has CORE_LEAST of the core sections; in the order of the first document.
    """
    word = F.lower("text")
    said = headings.where(word.isin([*CORE_SECTIONS, *MORE_SECTIONS])).groupBy("cluster", "path", "text").agg(F.min("pos").alias("pos"))
    core = said.groupBy("cluster", "path").agg(F.count_distinct(F.when(word.isin(list(CORE_SECTIONS)), word)).alias("core"))
    sizes = documents.join(core, ["cluster", "path"], "left").groupBy("cluster").agg(F.count("*").alias("documents"), F.min(F.coalesce("core", F.lit(0))).alias("core")).where(F.col("core") >= CORE_LEAST)
    often = said.groupBy("cluster", "text").agg(F.count("*").alias("n"), F.min_by("pos", "path").alias("pos"))
    return often.join(sizes, "cluster").where("n = documents").select("cluster", "text", "pos")


def sample_cycle(links: list[tuple[str, list[str]]]) -> list[str] | None:
    """The first cycle that a depth-first walk meets: documents by path, links in their order. links: (path, targets)."""
    out, done = dict(links), set()
    for start in sorted(out):
        chain, place, following = [], {}, []
        if start not in done:
            chain, place, following = [start], {start: 0}, [iter(out[start])]
        while chain:
            target = next(following[-1], None)
            if target is None:
                following.pop()
                done.add(chain[-1])
                del place[chain.pop()]
            elif target in place:
                return chain[place[target] :]
            elif target in out and target not in done:
                place[target] = len(chain)
                chain.append(target)
                following.append(iter(out[target]))
    return None


#: Rule -> the pattern that must occur in the sampled files, and what the evidence calls it.
GATES = {
    "CTX-001": ("placeholderSections", "section(s) that are empty or hold a placeholder only"),
    "CTX-002": ("checklistItems", "checklist item(s)"),
    "GRP-001": ("localLinks", "link(s) between files"),
    "REF-001": ("localLinks", "link(s) to files"),
    "REF-002": ("anchorLinks", "link(s) with an anchor"),
    "REF-003": ("images", "image(s)"),
    "TBL-002": ("tables", "table(s)"),
}


def propose(corpus: Corpus, found: DataFrame | None = None) -> list[dict]:
    """Rule entries for what the sampled files of the clusters hold, each with its options and the evidence, by rule and scope.

    Only the samples, SAMPLE files of each cluster, are looked at; of them counts, section names and links between them reach the driver,
    as one proposal may be made for each cluster.
    """
    found = clusters(corpus.paths) if found is None else found
    place = F.concat_ws(" ", "kind", "path")
    sampled = found.select(place.alias("cluster"), "include", F.explode("samples").alias("path"))
    only = sampled.select("path").distinct()
    small = Corpus(corpus.documents.join(only, "path", "left_semi"), corpus.files, corpus.router)
    counts = pattern_counts(small).join(sampled.select("path", "cluster"), "path")
    totals = {r["pattern"]: r["n"] for r in tally_totals(counts).where("cluster is null").collect()}
    tried = small.links.where((F.col("kind") == "local-file") & (file_part(F.col("raw_target")) != "")).select("path", "pos", "anchor", F.get(candidates(F.col("path"), file_part(F.col("raw_target"))), F.lit(0)).alias("target"))
    known = small.headings.select(F.col("path").alias("target"), F.col("slug").alias("anchor"), F.lit(True).alias("there")).distinct()
    real = tried.where("target <> path").join(only.select(F.col("path").alias("target")), "target").join(known, ["target", "anchor"], "left").where("coalesce(anchor, '') = '' or there")
    targets: dict[str, list[str]] = defaultdict(list)
    for r in real.orderBy("path", "pos").collect():
        targets[r["path"]].append(r["target"])
    cycle = sample_cycle([(r["path"], targets.get(r["path"], [])) for r in only.collect()])
    out = []
    for rule, (pattern, what) in GATES.items():
        if totals.get(pattern):
            out.append({"rule": rule, "options": {}, "evidence": f"sampled files hold {totals[pattern]} {what}"})
            if rule == "GRP-001" and cycle:
                out[-1]["evidence"] = "sampled files link in a circle: " + " -> ".join([*cycle, cycle[0]])
                if len(cycle) < MIN_CYCLE:
                    out[-1]["options"] = {"minCycleLength": len(cycle)}
    heads = small.headings.join(sampled.select("path", "cluster"), "path")
    shared = decision_sections(heads, sampled).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("s"))
    for r in shared.join(found.select(place.alias("cluster"), "include", "samples"), "cluster").orderBy("include").collect():
        if all(matches(f, [r["include"]]) for f in r["samples"]):
            names = [x["text"] for x in r["s"]]
            out.append({"rule": "SEC-001", "options": {"files": [r["include"]], "sections": names}, "evidence": f"sampled files in {r['include']} share {', '.join(names)}"})
    return sorted(out, key=lambda x: (x["rule"], (x["options"].get("files") or [""])[0]))
