"""Documents with every odd case, and the small tables that tests share."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "re", "so") for b in ("n", "st", "ra", "del", "")]
#: Columns that operators use for themselves.
CLASHING = "ids decoded score predicted slot shard epoch place n_tokens component_id kept digest block stored bucket clean_text n_lines n_removed term mask hot tokens part toxic left first of_source n_blocks p_source quota docs n search word other phrase rank label quality __x".split()


def prose(rng, n):
    words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]
    return "".join(w + (".\n" if i % 11 == 10 else " ") for i, w in enumerate(words)).strip()


def odd_rows(seed=1):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(5, 120))) for i in range(40)]
    base = prose(rng, 200)
    near = base.split(" ")
    rows += [(100 + i, " ".join(near[:i] + ["other"] + near[i + 1 :])) for i in range(12)]  # near copies
    rows += [(200 + i, rows[3][1]) for i in range(9)]  # copies
    rows += [(300, None), (301, ""), (302, "   \n\t "), (303, None), (304, "one"), (305, "one two"), (306, "ONE two")]
    rows += [(400, prose(rng, 30_000)), (401, "x" * 60_000), (402, "a<|endoftext|>b  c\n\n d <|endoftext|>")]
    rows += [(403, "é 中文 \U0001f600 ß İ ſ K don't I'll\r\n12345 \x00 end ")]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (6, "another text under a used id")]  # repeated rows, a used id
    rows += [(None, "a text without an id"), (None, None)]
    return rows


def odd_docs(spark, clashing=True):
    rows = [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"s{k % 3}", k) for k, (i, t) in enumerate(odd_rows())]
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs.select("*", *[F.lit("clash").alias(c) for c in CLASHING]) if clashing else docs


def unique_docs(spark):
    """Odd documents with unique ids."""
    seen, rows = set(), []
    for i, t in odd_rows():
        if i is not None and i not in seen:
            seen.add(i)
            rows.append((i, t, "en", f"s{i % 3}", len(t or "")))
    return spark.createDataFrame(rows, SCHEMA), {r[0]: r[1] or "" for r in rows}


def no_docs(spark):
    return odd_docs(spark).where("false")
