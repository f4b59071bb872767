import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def prose():
    """Texts with copies, near copies, shared passages, odd characters, null and empty ones."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = say(60)
    texts = [say(rng.randint(1, 200)) for _ in range(40)]
    texts += [texts[0], texts[0], texts[1] + " " + shared, shared + "\n" + texts[2], "x " + shared + shared]
    for k in range(6):
        w = texts[3 + k].split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", " \t\n\x0b", "one", "Two words", "A B C a b c A B C", "日本語 テキスト 🙂 café", "0 \x1f1   2½ x²y", shared, "<|endoftext|> it's\n\n  done  "]
    return texts


@pytest.fixture(scope="session")
def docs(spark, prose):
    """With a repeated row, a null id and names that clash with added columns."""
    rows = [(i, t, f"s{i % 4}" if i % 5 else None, "kept", 7, 0.5) for i, t in enumerate(prose)]
    rows += [rows[10], (None, prose[4], "s1", "kept", 7, 0.5)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_words string, size int, score double")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
