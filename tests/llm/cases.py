"""Rows that operators must bear: nulls, empty and long texts, repeated rows."""

DOC = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, "a", "en", "s", 1), (3, "a", "en", "s", 1), (None, "no id", None, "s", 5),
    (4, "!!! 123 ...", "de", None, 11), (5, "word " * 30_000, "en", "s", 150_000), (6, "x" * 50_000, "en", "s", 50_000),
    (7, "tab\tnew\nline　wide ́ é 中文 😀 \x00 \x1c end", "fr", "s", 40), (8, "Same text as nine.", "en", "s", 18),
    (9, "Same text as nine.", "en", "s", 18), (10, "An <|endoftext|> inside, <|startoftext|>and glued<|endoftext|>", "en", "s", 62),
]
