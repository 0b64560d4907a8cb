"""Small documents that hold the awkward cases, and plain Python versions of the contracts."""

import random
import re

from pyspark.sql import types as T

#: More names that operators use, or could.
CLASHING = ("row", "simhash_row", "bad_id", "bad_hash", "row_hash", "head_id", "head", "pii_text", "pii_note", "mix_note", "mix_n", "mix_source", "node", "group", "component", "_0", "_1", "with.dot")

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use for themselves.
        T.StructField("part", T.LongType()),
        T.StructField("salt", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("fp", T.DoubleType()),
        T.StructField("raw", T.StringType()),
        *(T.StructField(name, T.StringType()) for name in CLASHING),
    ]
)


def texts():
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(vocab, k=n))
    passage, copy = prose(60), prose(120)
    out = [
        None, "", " \n\t ", "a", "A b", "x" * 200, "12", copy, copy, copy + " tail", "Head " + copy[5:], prose(40) + passage + prose(30), passage + " " + prose(50), prose(10) + "\n" + passage,
        "Released under the MIT License. Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0 " * 3, "GNU General Public License, version 3", "This work is licensed under the GNU General Public License, version 3.",
        "mail a.b@c-d.org_x@y.zz, 1.2.3.4.5.6.7.8 and 300.1.1.1, card 4539 1488 0343 6467, +1 (555) 010-99999 end", "@a@b.c 10.0.0.1 é 4111-1111-1111-1111 +12", "IBAN GB82 WEST 1234 5698 7654 32 here; ssn 123-45-6789; nothing 123-45-6780",
        "wörter über straße\r\nzeile zwei\x0bdrei\x0cvier fünf", "日本語のテキスト。" * 30, "word " * 300, "<|endoftext|> and  double  spaces \n\n x ▁ y <s> </s>", "spam #### $$$$ |||| " * 40, prose(3000), "z" * 30000 + " " + prose(20),
    ]
    return out + [prose(rng.randint(55, 200)) for _ in range(40)]


def rows():
    out = [(i * 3 % 101, t, ["en", "de", None][i % 3], ["src0", "src1", None, "src0"][i % 4], None if t is None else len(t), i, "s", "k", float("nan"), "r", *("c" for _ in CLASHING)) for i, t in enumerate(texts())]
    out.append(out[7])  # a repeated row
    return out


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    return sorted((m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m.group()))
