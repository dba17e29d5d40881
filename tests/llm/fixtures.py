"""Small tables with the odd cases that every operator must take."""

LONG = " ".join(f"wort{i % 997}x{i}" for i in range(30_000))

DOCS = [
    (1, "The quick brown fox jumps over the lazy dog. It's late,  and\n\nthe dog sleeps.\n"),
    (2, None),
    (3, ""),
    (4, "   \n\t "),
    (5, "a"),
    (6, LONG),
    (7, "The quick brown fox jumps over the lazy dog. It's late,  and\n\nthe dog sleeps.\n"),
    (7, "A repeated id with another text! <|endoftext|> 123 456"),
    (8, "über   straße naïve  façade — «ok»\r\nÉté  Σίσυφος"),
    (8, "über   straße naïve  façade — «ok»\r\nÉté  Σίσυφος"),
    (None, "No id at all."),
    (10, " leading and trailing \n \n x . , ;;\x00 y"),
    (11, "!!! a.b,c 'tis we'll\x1cdone\x85now　wide"),
]


def documents(spark, rows=DOCS):
    """With extra columns whose names clash with those the operators use."""
    rows = [(a, b, "en", "src", len(b or ""), "x", 7, "y") for a, b in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, part int, fingerprint string")
