"""Documents with everything that may be odd about them."""

LONG = " ".join(f"word{i % 977} and" for i in range(60_000))
LINES = "same line here\nsame line here\n\n \nother"
TEXTS = [
    (None, None),
    (None, "text without an id"),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, LONG),
    (5, "the same text twice, word for word"),
    (5, "the same text twice, word for word"),
    (6, "the same text twice, word for word"),
    (7, LINES),
    (8, "Ünïcödé \U0001f600 ﬁ İ Σς \x1c\x85\xa0 mixed\x0bspace"),
    (9, "mail a.b@c.example.org call +1 (555) 010-9999 now, host 10.0.0.255, card 4111 1111 1111 1111."),
]
# Names that the operators use themselves.
EXTRA = ["number", "row", "key", "kept", "shard", "spans", "draw", "fingerprint", "rank"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in EXTRA)


def odd_documents(spark, texts=TEXTS):
    rows = [
        (i, t, ["en", None, "xx"][n % 3] if not (i == 5) else "en", None, None if t is None else len(t), *[None if n % 2 and i != 5 else "x"] * len(EXTRA))
        for n, (i, t) in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def by_id(frame, *columns):
    """Rows as sorted tuples; nulls first."""
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))
