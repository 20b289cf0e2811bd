"""Small document tables with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing names."""

ODD_TEXTS = [
    None, "", " ", "one", "a b", "the the the the the the", "x" * 3000, "word " * 4000, "  two  blanks ", "line\n\nline\n", "tab\tand\x0bothers\x0c\r\n",
    "日本語 テキスト é ñ", "null\x00byte", "<|endoftext|> special <|startoftext|>", "It's 'quoted', isn't it?", "﻿foo bar baz", "emoji 😀 👍🏽 done", "İstanbul ΑΣ ß ﬁ", "é combining",
]


def odd_documents(spark):
    """doc_id and text with extra columns named like the operators' own."""
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}", i, None, "x") for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], rows[6]]
    rows.append((None, "no id here", None, None, None, None, None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, kept string")


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
