"""Recall and precision of the secret scan on findings of another generator than the one it learns from."""

import hashlib
import random
import string
import uuid

from tablesmith.llm import secrets
from tests.llm.test_corpus import frame

LEET = str.maketrans("aeiost", "431057")
ANIMALS = "otter badger heron marten lynx falcon weasel puffin gecko walrus bison ferret".split()


def planted(seed=71, n=400):
    """(text, secret or None): secrets as configuration files, code and mails hold them, and what is mistaken for them."""
    r = random.Random(seed)
    token = lambda alphabet, k: "".join(r.choices(alphabet, k=k))
    out = []
    for _ in range(n):
        pool = string.ascii_letters + string.digits
        value = r.choice(
            [
                lambda: r.choice(ANIMALS).translate(LEET) + str(r.randint(10, 9999)),
                lambda: "".join(r.sample(ANIMALS, 3)),
                lambda: "-".join(r.sample(ANIMALS, 4)),
                lambda: r.choice(ANIMALS).title() + "&" + str(r.randint(1, 99)) + "!",
                lambda: token(pool + "_-", r.randint(24, 50)),
                lambda: token("0123456789abcdef", 40),
                lambda: str(uuid.UUID(int=r.getrandbits(128))),
                lambda: "eyJ" + token(pool, 30) + "." + token(pool + "_-", 80) + "." + token(pool + "_-", 43),
                lambda: token(pool + "/+", 43) + "=",
            ]
        )()
        line = r.choice(['password = "{}"', "db_password: {}", "API_KEY={}", "export AUTH_TOKEN='{}'", "my secret is {} , keep it", '"client_secret": "{}",', "access_key={};"]).format(value)
        out.append((f"{r.choice(ANIMALS)} went on\n{line}\nand back", value))
    for _ in range(n):
        clean = r.choice(
            [
                lambda: f"commit {token('0123456789abcdef', 40)} by someone",
                lambda: f"see https://docs.example.org/a/{token(string.ascii_lowercase, 12)}/page-{r.randint(1, 99)}.html",
                lambda: f"uuid: {uuid.UUID(int=r.getrandbits(128))}",
                lambda: f"write to {r.choice(ANIMALS)}.{r.choice(ANIMALS)}.{r.randint(1, 999)}@mail.example.com today",
                lambda: f"card {token(string.digits, 16)} was charged",
                lambda: f"the password: required field, the token = None and {r.choice(ANIMALS)}",
                lambda: "the key is to read and the secret: {} the user".format(r.choice(["not", "that", "from"])),
                lambda: f"sha256 {token('0123456789abcdef', 64)} of the file",
                lambda: f"phone +49 {token(string.digits, 9)} or {'-'.join(ANIMALS[:4])}",
                lambda: "password=<password> token=${TOKEN} api_key=your_key_here",
            ]
        )()
        out.append((clean, None))
    return out


def test_findings_of_another_generator(spark):
    rows = planted()
    docs = frame(spark, [(i, t, "src1") for i, (t, _) in enumerate(rows)])
    got = secrets.scan(docs, secrets.forest(spark)).where("is_secret").collect()
    found = {(x.doc_id, x.secret_sha256) for x in got}
    hit = sum((i, hashlib.sha256(v.encode()).hexdigest()) in found for i, (_, v) in enumerate(rows) if v)
    wrong = {x.doc_id for x in got if rows[x.doc_id][1] is None}
    print("recall", hit / 400, "clean texts flagged", len(wrong) / 400, [rows[i][0] for i in sorted(wrong)[:5]])
    missed = [v for i, (_, v) in enumerate(rows) if v and (i, hashlib.sha256(v.encode()).hexdigest()) not in found]
    print(missed[:20])
    assert hit >= 0.9 * 400 and len(wrong) <= 0.1 * 400


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "password ="), (4, "password"), (5, "x" * 300_000 + "1"), (6, 'password = "hunter2hunter"'), (6, 'password = "hunter2hunter"'), (None, "token: correcthorsebatterystaple")]
    docs = frame(spark, [(*r, None) for r in rows]).selectExpr("*", "1 as core", "2 as word", "3 as runs", "4 as any_near")
    got = secrets.scan(docs, secrets.forest(spark)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert [x.secret_sha256 for x in got if x.doc_id == 6] == [sha("hunter2hunter")] * 2 and all(x.is_secret for x in got if x.doc_id == 6)
    assert [x.secret_sha256 for x in got if x.doc_id is None] == [sha("correcthorsebatterystaple")]
    assert {x.doc_id for x in got} == {5, 6, None} and next(x for x in got if x.doc_id == 5).n_chars == 300_001
    assert secrets.scan(docs.limit(0), secrets.forest(spark)).count() == 0
