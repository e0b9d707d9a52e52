"""Tables that the tests of the training-data operators share."""

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(120_000))

#: Nulls in every column, empty and very long texts, ties, repeated rows.
ODD = [
    (None, None, None, None, None),
    (None, "a text without an id that is long enough for all of the rules here", None, "s1", 3),
    (1, None, "en", "s1", None),
    (2, "", "en", None, 0),
    (3, " \t\n\x0b\x0c\r ", None, "s2", 7),
    (4, LONG, "en", "s3", len(LONG)),
    (5, "The same short text stands here and there and everywhere.", "en", "s1", 5),
    (5, "The same short text stands here and there and everywhere.", "en", "s1", 5),
    (6, "The same short text stands here and there and everywhere.", "en", "s4", 5),
    (7, "Été 中文 <|endoftext|> naïve ### 123 \U0001f600", "fr", "s5", 9),
    (-8, "x", "de", "s6", 1),
]
