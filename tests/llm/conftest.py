import random

import pytest


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(1, 9))) for _ in range(400)]


@pytest.fixture(scope="session")
def texts(words):
    """Odd and ordinary texts: null, empty, long, copies, near copies, shared passages, repeats."""
    rng = random.Random(6)

    def said(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage, other = said(120), said(70)
    out = [None, "", " \n\t ", "one", "two words", "x" * 5000, "ab" * 900, said(19), said(20), said(300), said(6000)]
    out += [out[9], out[9], out[9].replace("\n", " ") + " end", out[9].upper()]
    out += [f"{said(30)} {passage} {said(40)}" for _ in range(12)]
    out += [f"{said(25)} {other}\n{said(10)} {other} {said(5)}" for _ in range(5)]
    out += [passage, passage[:450], passage[7:420], "Shti " * 700, said(50) + "\n" + said(50) + "\n\n" + "same line here\n" * 9]
    out += [" ".join(t.split()[:200] + ["changed"] + t.split()[200:]) for t in (out[9], out[10])]
    out += ["mail a.b@c.example.com +1 (017) 555-7713 4111111111111111 10.1.2.3", "<|endoftext|> é 中文 \x85 end", "aa\x00bb " * 90]
    return out


@pytest.fixture(scope="session")
def odd_docs(spark, texts):
    """Those texts with columns that clash with names in use; one row is given twice, one id is null."""
    rows = [(i if i != 3 else None, t, "x", i, "y") for i, t in enumerate(texts)]
    rows.append(rows[12])
    return spark.createDataFrame(rows, "doc_id long, text string, t string, n long, key string").repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def as_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


