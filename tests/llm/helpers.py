import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    sources = [f"s{i % 7}" for i in range(len(texts))] if sources is None else sources
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, t, s in zip(ids, texts, sources)], DOCS)


def random_texts(n, seed=0, words=40, vocabulary=400, near=0.4):
    """Random texts, a share of them light edits of earlier ones."""
    r = random.Random(seed)
    made = []
    for _ in range(n):
        if made and r.random() < near:
            w = r.choice(made).split(" ")
            for _ in range(r.choice([0, 0, 1, 2])):
                w[r.randrange(len(w))] = f"w{r.randrange(vocabulary)}"
        else:
            w = [f"w{r.randrange(vocabulary)}" for _ in range(r.randint(1, words))]
        made.append(" ".join(w))
    return made
