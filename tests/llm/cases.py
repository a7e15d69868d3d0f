"""Small inputs with the awkward cases: nulls, blanks, long texts, repeats, clashing columns."""

import random

WORDS = "the of and river stone lamp ünder über corn apple träume no yes quick slow table chair".split()
#: Columns whose names the operators use themselves.
EXTRA = {"n_words": 7, "kept": "no", "shard": 3, "node": 1, "_key": 2, "row": "r", "size": 9, "taken": 1, "h": 5, "text2": None}


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(n))


def documents(spark, seed=1, n=60, extra=False):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(50, 200)) for _ in range(n)]
    rows = []
    for i, t in enumerate(texts):
        rows.append((len(rows), t, "en", rng.choice(["a", "b", "c"])))
        if i % 6 == 0:  # near copies
            ws = t.split()
            for _ in range(3):
                edited = list(ws)
                edited[rng.randrange(len(ws))] = "changed"
                rows.append((len(rows), " ".join(edited), "en", "a"))
        if i % 10 == 0:
            rows.append((len(rows), t, "en", "b"))
    rows += [(len(rows), None, None, None), (len(rows) + 1, "", "en", "a"), (len(rows) + 2, " \t\n ", "en", None), (len(rows) + 3, "One two", "en", "z"), (len(rows) + 4, "one TWO", "en", "z")]
    rows.append((rows[0]))  # a repeated row
    rows.append((len(rows) + 3, "\n".join(["menu home about", prose(rng, 4000), "menu home about"]), "en", "c"))
    rows.append((len(rows) + 3, "word " * 3000 + "x" * 5000, "en", "c"))
    rows.append((None, "a text without an id " * 20, "en", "a"))
    full = [(*r, len(r[1] or ""), *(EXTRA.values() if extra else ())) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    if extra:
        schema += ", n_words int, kept string, shard int, node int, _key int, row string, size int, taken int, h int, text2 string"
    return spark.createDataFrame(full, schema)


def empty(spark):
    return documents(spark, n=1).limit(0)
