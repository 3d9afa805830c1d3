import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, fp int, size double, key string, n int, copies int, start int"


def rows():
    long = " ".join(f"w{i * 7919 % 5003}x" for i in range(40_000))
    texts = {
        0: None, 1: "", 2: " \n\t ", 3: "one", 4: "it's a <|im_end|> test 12,345", 5: long, 6: "the same text again and again", 7: "the same text again and again",
        8: "the Same text AGAIN and again", 9: "Ünïcödé  naïve 漢字 🙂\x00 end", 10: "a b c d e f g h i j", 11: "a b c d e f g h i j k", 200: long + " tail", 300: "x " * 3000,
    }
    out = [(i, t, "en", "s" if i % 3 else None, None, "h", 1, 2.0, "k", 3, 4, 5) for i, t in texts.items()]
    out += [out[6], out[6], (None, "no id", None, "s", 1, *out[0][5:]), (None, None, None, None, None, *out[0][5:]), (10, "another text of ten", "en", "z", 1, *out[0][5:])]
    return out


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns named as operators name theirs."""
    return spark.createDataFrame(rows(), COLUMNS).repartition(5).persist()


@pytest.fixture(scope="session")
def plain_docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(plain_docs):
    return {r["doc_id"]: r["text"] for r in plain_docs.select("doc_id", "text").collect()}
