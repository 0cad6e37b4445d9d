"""Documents with nulls, empty and very long texts, ties, repeated rows and clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, key string, m string"

WORDS = [f"w{k}" for k in range(60)]


def odd_documents(spark):
    base = " ".join(WORDS)
    texts = [base, base, None, "", "   \n\t", "one", "one two three", base.replace("w59", "zz"), "x" * 50_000, " ".join(f"t{k % 997}" for k in range(30_000)), "Ünï cödé é́ 日本 #$%", "a\nb\na\n\n a\n", "<|endoftext|> ▁ \x00 end"]
    rows = [(k, t, "en" if k % 2 else None, "s" if k % 3 else None, None, 0.5, "c", "k", "m") for k, t in enumerate(texts)]
    rows += [rows[0], rows[5], (None, base, "en", "s", 1, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
