import hashlib
import random
import re
import string

from pyspark.sql import functions as F

from quillspark.llm import secrets
from tests.against import assert_same

ASSIGN = re.compile("((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCOUNT = re.compile("(?ai:(user|username|login|account|client_?id|key_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@+-]+))")
PLACE = re.compile("(?ai:(host|hostname|server|endpoint)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.:/-]+)|[A-Za-z][A-Za-z0-9+.-]{0,20}://[^\x00-\x20\"'<>`]+)")
ORDER = ["assign", "access", "hex", "short", "account", "endpoint", "opaque"]


def base(text):
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return spans + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]


def plain(text, reach=300):
    """All spans, by comparing every two."""
    text = text or ""
    kept = base(text)
    weak = [("short", *m.span()) for m in ASSIGN.finditer(text) if 4 <= len(m[2]) < 8]
    weak += [("account", *m.span()) for m in ACCOUNT.finditer(text)] + [("endpoint", *m.span()) for m in PLACE.finditer(text)]
    weak += [("opaque", *m.span()) for m in re.finditer("[A-Za-z0-9+/_-]{20,}", text) if all(re.search(c, m[0]) for c in ("[A-Z]", "[a-z]", "[0-9]"))]
    for x in sorted(weak, key=lambda x: ORDER.index(x[0])):
        if not any(ORDER.index(k) < ORDER.index(x[0]) and a < x[2] and b > x[1] for k, a, b in kept):
            kept.append(x)
    blank = [m.start() for m in re.finditer("\n[ \t\r]*\n", text)]
    scope = lambda a: sum(m < a for m in blank)
    found = []
    for kind, a, b in kept:
        close = {k for k, c, d in kept if scope(c) == scope(a) and (c - b <= reach and c >= a or a - d <= reach and c <= a)}
        key, identifier, strong = "access" in close, bool(close & {"access", "account"}), bool(close & {"assign", "hex"})
        secret, place = strong or bool(close & {"short", "opaque"}), "endpoint" in close
        if kind in ORDER[:3] or (key or identifier and place if kind in ("short", "opaque") else strong or secret and place if kind == "account" else identifier and secret):
            found.append((kind, a, b))
    return sorted(found, key=lambda x: (x[1], ORDER.index(x[0])))


def said(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def corpus():
    rng = random.Random(12)
    secret = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n - 3)) + "aZ7"
    parts = [
        lambda: f"{rng.choice(['password', 'API_KEY', 'Token', 'apikey', 'Secret', 'passwd'])}{rng.choice(['=', ': ', '  =  ', chr(34) + ': ' + chr(34)])}{secret(rng.choice([5, 7, 8, 30]))}",
        lambda: "AKIA" + "".join(rng.choice(string.ascii_uppercase + string.digits) for _ in range(rng.choice([3, 12, 16]))),
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([31, 32, 40]))),
        lambda: f"user = {secret(6)}", lambda: f"client_id: {secret(9)}", lambda: f"https://api.example.org/v1?{secret(4)}", lambda: f"host=db{rng.randrange(9)}.internal:5432",
        lambda: secret(40), lambda: "ordinary words é ü 漢字 😀 " * rng.randrange(1, 9), lambda: "\n \n", lambda: "\n", lambda: "ſecret=abcdefgh toKen=12345678",
    ]
    rows = [(i, " ".join(rng.choice(parts)() for _ in range(rng.randrange(1, 25)))) for i in range(400)]
    rows += [(900, "AKIA" + "A" * 20 + "\n" + secret(40)), (901, secret(40)), (902, "AKIA" + "A" * 20 + "\n\n" + secret(40)), (903, "AKIA" + "A" * 20 + " x" * 200 + " " + secret(40))]
    rows += [(904, "user=ann host=db.example"), (905, "user=ann pass host=db.example password=abcd"), (906, None), (907, ""), (None, "token=abcdefgh1"), (908, "token=abcdefgh1"), (908, "token=abcdefgh1")]
    return rows


def test_against_every_pair(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"row": F.lit(1), "part": F.lit("x"), "found": F.lit(2), "a.b": F.lit(3)})
    got = sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in secrets.secret_report(docs).collect())
    want = []
    for d, t in rows:
        own = sorted(base(t or ""), key=lambda x: (x[1], ORDER.index(x[0])))
        want.append((str(d), *(sum(k == kind for k, _, _ in own) for kind in ORDER[:3]), hashlib.sha256(said(own).encode()).hexdigest(), said(plain(t))))
    assert got == sorted(want)
    carried = secrets.secrets(docs)
    assert carried.columns == ["doc_id", "text", "row", "part", "a.b", "found"] and carried.count() == len(rows)


def test_parts_count_only_together(spark):
    by = {r.doc_id: [k.split(":")[0] for k in r.spans.split(",")] if r.spans else [] for r in secrets.secret_report(spark.createDataFrame(corpus()[400:], "doc_id long, text string")).collect()}
    assert by[900] == ["access", "opaque"] and by[901] == [] and by[902] == by[903] == ["access"]
    assert by[904] == [] and by[905] == ["account", "endpoint", "short"]


def test_long_and_empty(spark):
    text = ("user=ab " + "x" * 1000 + " password=abcdef ") * 500 + "A" * 1_000_000 + " http://e.example"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = secrets.secret_report(docs).first()
    assert row.n_assign == row.n_linked == 0 and row.spans == ""  # accounts and short values, but no endpoint near them
    assert secrets.secret_report(docs.limit(0)).count() == 0


def test_sql_finds_the_same(spark):
    import duckdb

    rows = [r for r in corpus() if r[0] is not None and r[0] != 908]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert_same(secrets.secret_report(spark.createDataFrame(rows, "doc_id long, text string")), db.sql(secrets.SQL))
