"""Values assigned to a secret's name: every one is judged by the forest, in the scan and in the pipeline's stage."""

import pytest
from pyspark.sql import functions as F

from claimspark.llm import secret_scan

SCHEMA = "doc_id long, text string, extra string"
KEPT = [
    "tokenizer(max_token=512, pad_token = 0)",
    "def f(token: Token) -> None",
    "token = get_token()",
    "password = getpass.getpass()",
    "api_key = load_key(path)",
    "secret = 3.14",
    "the token: Ring of power",
    "credential: Alice",
    "self.auth = settings.auth_backend",
    "tokens: list[str] = []",
    None,
    "",
]
MASKED = {
    "https://x.org/?token=aGVsbG8gd29ybGQ&x=1": "https://x.org/?token=[SECRET]&x=1",
    "postgres://admin:hunter2@db/x": "postgres://admin:[SECRET]@db/x",
    'password = "Tr0ub4dor&3" # set': 'password = "[SECRET]" # set',
    "DB_PASSWORD='two words' end": "DB_PASSWORD='[SECRET]' end",
    "api_key: 9f86d081884c7d659a2feaa0c55ad015 and max_token=512": "api_key: [SECRET] and max_token=512",
    "pwd=x1!; later x1! stays, being short": "pwd=[SECRET]; later x1! stays, being short",
    "passwd=S3cr3t@Value99, again S3cr3t@Value99": "passwd=[SECRET], again [SECRET]",
}


def test_lines(spark):
    rows = [(i, t, "") for i, t in enumerate([*KEPT, *MASKED])]
    got = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t, _ in rows:
        assert got[i].redacted == MASKED.get(t, t), t
        assert got[i].n_secrets == (t in MASKED) == len(got[i].secrets)


def test_votes_are_those_of_the_plain_forest(spark):
    """Heads and values as the pattern finds them, votes by trees walked in Python."""
    texts = [f"{h}{v}{h[-1] if h[-1] in chr(34) + chr(39) else ' '} end" for h, v, _ in secret_scan.labelled_assignments(300, seed=5) if h[-1] != ":"]
    df = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA)
    forest = secret_scan.train_assigned()
    judged = secret_scan.judged_values(F.col("text"), secret_scan.ASSIGNED, 0.5, forest)
    n = 0
    for r in df.select("text", judged.alias("x")).collect():
        text, at = "", 0
        for g in r.x.given:
            assert g.score == pytest.approx(secret_scan.vote(forest, secret_scan.assigned_features(g.head, g.value)))
            begin = r.text.index(g.head + g.value, at)
            text += r.text[at:begin] + g.head + (secret_scan.MASK if g.score >= 0.5 else g.value)
            at, n = begin + len(g.head) + len(g.value), n + 1
        assert r.x.text == text + r.text[at:]
    assert n > 200


def test_held_out_findings():
    forest = secret_scan.train_assigned()
    said = [(secret_scan.vote(forest, secret_scan.assigned_features(h, v)) >= 0.5, y) for h, v, y in secret_scan.labelled_assignments(1500, seed=99)]
    hits = sum(p and y for p, y in said)
    assert hits / sum(y for _, y in said) > 0.95 and hits / sum(p for p, _ in said) > 0.97


def test_longer_secrets_hold_shorter_ones(spark):
    """A token inside an assigned value is no second secret; the bound on masking everywhere is a parameter."""
    df = spark.createDataFrame([(1, "password=abcd1234efgh5678!x and x1!", ""), (2, "pwd=x1! x1!", "")], SCHEMA)
    got = {r.doc_id: r for r in secret_scan.scan(df, everywhere=2).collect()}
    assert got[1].secrets == ["abcd1234efgh5678!x"] and got[1].n_secrets == 1
    assert got[2].redacted == "pwd=[SECRET] [SECRET]"


def test_stage(spark):
    df = spark.createDataFrame([(1, "max_token=512", "a"), (2, "password=hunter2!!", "b"), (3, None, None)], "doc_id long, text string, redacted string")
    assert sorted(map(tuple, secret_scan.stage(spark, df, "").collect())) == [(1, "max_token=512", "a"), (2, "password=[SECRET]", "b"), (3, None, None)]
