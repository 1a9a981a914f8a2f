"""Small documents with nulls, repeats, long texts and columns whose names clash with results."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(n: int = 120, seed: int = 3) -> list[tuple]:
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefgh\u00e9") for _ in range(draw.randint(1, 7))) for _ in range(400)]
    passage = " ".join(draw.choice(words) for _ in range(60))
    rows = []
    for i in range(n):
        own = [draw.choice(words) for _ in range(draw.choice([0, 1, 2, 30, 80, 150]))]
        text = " ".join(own)
        if i % 7 == 1:
            text = f"{text}\n{passage} {draw.choice(words)}"
        if rows and i % 5 == 2:
            text = draw.choice(rows)[1] or ""
            if i % 10 == 2 and text:
                text += " changed"
        rows.append((i, text, "en", f"src{i % 3}" if i % 11 else None, len(text)))
    rows.append((n, None, None, None, None))
    rows.append((n + 1, "", "en", "src0", 0))
    rows.append((n + 2, " \n\t ", "en", "src0", 4))
    rows.append((n + 3, "word " * 20_000, "en", "src1", 100_000))
    rows.append((n + 4, "x" * 50_000, "en", "src1", 50_000))
    rows.append((3, rows[3][1], "en", "src0", 1))  # a row twice
    rows.append((3, rows[3][1], "en", "src0", 1))
    rows.append((None, "a row without an id " * 30, "en", "src2", 600))
    return rows


def frame(spark, rows=None, schema: str = SCHEMA):
    return spark.createDataFrame(corpus() if rows is None else rows, schema).repartition(3)
