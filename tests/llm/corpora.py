"""Small documents tables for the corpus operators' tests."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside; they must not clash with a user's columns.
CLASHES = ["row_key", "size", "n", "prefix", "node", "comp", "part", "slice", "kind", "order", "label", "bits", "_n",
           "ids", "start", "length", "n_shared", "group_size", "sequence_id", "block", "held_out", "bucket", "copies"]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus(n: int = 60, seed: int = 5) -> list[tuple]:
    """Prose with exact copies, near copies, embedded passages, repeated lines, nulls, blanks, a long run without
    spaces and repeated rows."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefghiklmnoprstuv") for _ in range(rnd.randint(1, 8))) for _ in range(3000)]

    def prose(k):
        out = []
        for w in range(k):
            out.append(rnd.choice(vocab[:40] if rnd.random() < 0.3 else vocab))
            if w % 17 == 16:
                out[-1] += ".\n" if rnd.random() < 0.3 else "."
        return " ".join(out)

    texts = [prose(rnd.randint(60, 260)) for _ in range(n)]
    passage = prose(75)
    for k in range(0, 12, 3):
        at = texts[k].split(" ")
        texts[k] = " ".join(at[:30] + passage.split(" ") + at[30:])
    texts += [texts[1], texts[1].replace(" ", "  "), "  " + texts[2] + "\n", texts[4].upper()]
    for k in (5, 5, 5, 6):
        at = texts[k].split(" ")
        at[rnd.randrange(len(at))] = "changed"
        texts.append(" ".join(at))
    line = "one line that is said again and again in this text of all texts here"
    texts += ["\n".join([line] * 12), "#$% " * 80, "The " * 90, "", "   \n\t ", "short text", "x" * 9000, "naïve Café ÀÉ 東京 " * 20]
    rows = [(k, t, "en", "src0", len(t)) for k, t in enumerate(texts)]
    rows += [(900, None, None, None, None), (901, None, "en", "src1", 0), (None, texts[7], "en", "src1", 5),
             (None, prose(80), None, None, None), rows[8], rows[8]]
    return rows


def frame(spark, rows, folder, extra: bool = False):
    """A documents table in ``folder``, read back in two files."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.select("*", *[F.lit(k).alias(name) for k, name in enumerate(CLASHES)])
    path = str(folder / f"documents-{len(rows)}-{extra}.parquet")
    df.repartition(2, "text").write.parquet(path)
    return spark.read.parquet(path)
