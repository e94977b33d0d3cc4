"""Small texts with every awkward case, and a table of them."""

TEXTS = [
    None,
    "",
    " \t\n",
    "one",
    "The cat sat on the mat and the cat sat on the hat. " * 3,
    "word " * 300 + "\n\nword word\nword word\n",
    "Ünïcode façade — naïve coöperation 　 日本語の文章 and İstanbul ǅ.",
    "x" * 30_000,
    "日本語学校" * 3_000,
    "  leading and   trailing  \n\n lines \n lines \n",
    "mail a.b+c@mail.example.com, x@y, @z.com, p@q..r, a@b.c@d.e or +1 (372) 555-7739; 1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, 4111111111111111 and token = \"2abc3ff2ca8fb1e4\" https://u:p@host.example/x?y=1.",
    "<|endoftext|> special <|startoftext|>text<|endoftext|>",
    "don't we'll they've I'm 's 'sx ''s 12345 a1b2",
    "same words here to be found again " * 20,
    "same words here to be found again " * 20,
]


def table(spark, texts=None, lang="en"):
    rows = [(i, t, lang if i % 3 else None, "src", 1, "clash") for i, t in enumerate(TEXTS if texts is None else texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, start string")


def empty(spark):
    return table(spark, [])
