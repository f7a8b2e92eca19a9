import pytest

WORDS = "the and of in that was for with house river stone light water green small table".split()


def prose(i: int, n: int) -> str:
    return " ".join(WORDS[(i * 7 + k * k + k * i) % len(WORDS)] + str((i * 31 + k) % 17 if k % 5 == 0 else "") for k in range(n)) + "."


@pytest.fixture(scope="session")
def texts():
    """Prose, copies, near copies, odd and long texts."""
    base = [prose(i, 40 + i % 30) for i in range(40)]
    odd = ["", " ", "a", "A", "one two", "\n\n", "日本語 テスト 🙂", "x" * 5000, "word " * 3000, "don't  We'LL <|endoftext|> é\t\x1c", "\0 nul \0x", "ÀÉ straße ŉ", None, None]
    return base + [base[0].upper(), base[0], base[1], base[2] + " more", base[3].replace("the", "then", 1)] + odd


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With a repeated row, a null identifier and columns whose names the operators use."""
    from inkveil.llm.common import ship

    ship(spark)
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i % 4}" if i % 5 else None, i, f"x{i}", 1) for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[1], "en", "s1", 0, "n", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, slot int").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
