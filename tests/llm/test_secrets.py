"""Secrets of any length, short and quoted ones, and newer formats."""

from __future__ import annotations

import random
import string

from pyspark.sql import functions as F

from lodestrata.llm import secret_scan

DOCS = "doc_id long, text string"


def test_short_long_and_quoted_secrets(spark):
    rng = random.Random(9)
    alnum = string.ascii_letters + string.digits
    chars = lambda n: "".join(rng.choice(alnum) for _ in range(n))
    long, longer, user = chars(136), chars(5000), "u" * 300
    plain = [
        ('config "db_pass": "s3cr3tV@lue" end', "s3cr3tV@lue"), ("run with pwd=abc12 today", "abc12"), ('the passphrase is "blue horse staple nine" they said', "blue horse staple nine"), (f'password = "{long}" end', long), (f"password={longer} end", longer),
        (f"postgres://{user}:{chars(12)}@db", None), (f"charge sk_live_{chars(24)} now", None), (f"clone glpat-{chars(20)} now", None),
    ]
    rows = [(i, t) for i, (t, _) in enumerate(plain)]
    model = secret_scan.train(secret_scan.example_findings(spark))
    out = secret_scan.scan(spark.createDataFrame(rows, DOCS), F.lit(None), model).where("kept").collect()
    found = {(r["doc_id"], rows[r["doc_id"]][1][r["start"] - 1 : r["start"] - 1 + r["length"]]) for r in out}
    for i, (text, value) in enumerate(plain):
        want = value or next(w for w in text.replace("@db", " ").replace(f"{user}:", " ").split() if len(w) >= 12 and w != "postgres://")
        assert (i, want) in found, (text[:60], found)
    harmless = ['the compass: north of here', 'password: "enter your new password here"', "pass the salt", "bypass: true", 'a token is "optional" here']
    rows = list(enumerate(harmless))
    assert not [r for r in secret_scan.scan(spark.createDataFrame(rows, DOCS), F.lit(None), model).where("kept").collect()]


def test_a_very_long_value_and_text(spark):
    value = "aB3" * 400_000
    rows = [(1, f"token={value} end"), (2, "x" * 2_000_000 + ' secret="' + "q7" * 10), (3, "password=" * 50_000)]
    got = {(r["doc_id"], len(r["candidate"])) for r in secret_scan.candidates(spark.createDataFrame(rows, DOCS), F.lit(None)).collect()}
    assert (1, len(value)) in got and {i for i, _ in got} >= {1, 2, 3}
