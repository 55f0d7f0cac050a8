"""Secret scan: a wide pattern finds candidates, a small random forest, written out as SQL, removes false positives."""

from __future__ import annotations

import functools
import random
import string
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYWORD = "(token|secret|passw|passphrase|pwd|api_?-?key|access|auth|bearer|credential|private|key)"
#: A name with a keyword, a sign that assigns, and the value's opening quote. Names are cut to bounded lengths, so that long runs cost no more.
ASSIGNED = "[A-Za-z0-9_.-]{0,30}(?i:" + KEYWORD[1:-1] + ")[A-Za-z0-9_.-]{0,30}[\"']?[ \\t]{0,3}(?:[:=]|=>)[ \\t]{0,3}[\"']?"
VALUE = "[^\\x00-\\x20\"'<>,;`]{6,}"
#: What is judged: the value after such a name, or a run of 16 or more token characters anywhere.
CANDIDATE = f"(?:{ASSIGNED}{VALUE}|[A-Za-z0-9_+/-]{{16,}}={{0,2}})"
BEFORE, AFTER = 40, 12
#: The dictionary: common words of prose and of names in code.
WORDS = "(" + "|".join(
    """about abstract access account action address admin after agent alpha also android another answer apple application array asset async author auto
    back base battery bean because before begin between beta block board body book boolean border bottom branch browser buffer build builder button cache call callback
    change channel char check child class clean clear client close cloud code color column command comment commit common company component config connect constant content
    context control controller copy core correct count country course create current custom data date debug default delete demo detail device dialog digest direct directory
    docs document domain down draft driver during each edit element empty enable encode engine entity entry environment error event every example exception export
    factory false field file filter final find first folder font footer form format found frame from function general generic get global good great group guide handler
    hash have header hello here history home horse host html http human icon image impl import index info input insert instance integer interface internal item
    java job just key keyboard label language last layer layout left length level library license light like line link list local lock log login long machine main make manager map
    market master match member memory menu message method middle mobile mode model module money monday month more most mouse move name native network never next node
    none normal note notice null number object office only open option order other output over owner package page panel parameter parent parse part password path pattern people
    person phone place player plugin point policy port position post power present preview private process product profile program project property protocol provider proxy public
    query question queue read record redirect reference region release remote remove render replace report request required reset resource response rest result return right role
    root route rule sample save scale schema screen script search second section secure select send sequence server service session setting shape share short should simple single
    singleton site size small some sort source space spring staple start state static status step stop storage store stream string style submit summary support switch system
    table target task team template term test text than that their them then there these thing this thread through time title today token tool top total track tree true type
    under unit until update upload user using util valid value vendor version video view visit warning water week well what when where which while white widget width will window with
    word work world would write year your the and tion ing ent xxxx 0000 1234 abcd changeme placeholder dummy""".split()
) + ")"
PLACEHOLDER = "(example|sample|dummy|placeholder|change_?me|your[_-]|xxxx|[*.x]{6}|[$]|[{]|redacted|none$|null$|true$|false$|undefined)"
HASHES = "(sha|md5|commit|digest|checksum|uuid|revision|etag|integrity|hash|blob|tree)"
FEATURES = ("n", "runs", "digits", "uppers", "lowers", "marks", "hexes", "others", "covered", "longest", "path", "placeholder", "near", "joined", "hash_near", "quoted", "closed", "says_after", "called")


def features_sql(cand: str, before: str, after: str, source: str, dialect: str = "spark") -> dict[str, str]:
    """Feature -> SQL over a candidate, what stands before and after it, and its source's path."""
    g = ", 'g'" if dialect == "duckdb" else ""
    like = (lambda x, p: f"(CASE WHEN regexp_matches({x}, '{p}') THEN 1.0 ELSE 0.0 END)") if dialect == "duckdb" else (lambda x, p: f"(CASE WHEN {x} RLIKE '{p}' THEN 1.0D ELSE 0.0D END)")
    num = lambda x: f"CAST({x} AS DOUBLE)"
    without = lambda p, x=cand: f"length(regexp_replace({x}, '{p}', ''{g}))"
    share = lambda p, x=cand: f"({num(f'length({x}) - {without(p, x)}')} / {num(f'length({x})')})"
    runs = cand
    for p, to in (("[0-9]+", "0"), ("[a-z]+", "a"), ("[A-Z]+", "A"), ("[_+/=-]+", "-")):
        runs = f"regexp_replace({runs}, '{p}', '{to}'{g})"
    return {
        "n": num(f"length({cand})"),
        "runs": f"({num(f'length({runs})')} / {num(f'length({cand})')})",
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "marks": share("[_+/=-]"),
        "hexes": share("[0-9a-f]"),
        "others": share("[^A-Za-z0-9_+/=-]"),
        "covered": share(WORDS, f"lower({cand})"),
        "longest": num(without("[a-z]{4,}")),
        "path": f"greatest({like(cand, '/[a-z]+/')}, {like(f'coalesce(lower({source}), {chr(39)*2})', '(test|example|fixture|sample)')})",
        "placeholder": like(f"lower({cand})", PLACEHOLDER),
        "near": like(f"lower({before})", KEYWORD),
        "joined": like(f"lower({before})", KEYWORD + "[a-z_ -]*[ :=]+.?$"),
        "hash_near": like(f"lower({before})", HASHES + "[^ ]{0,3}[ :=]*.?$"),
        "quoted": like(before, "[^A-Za-z0-9 ]$"),
        "closed": like(after, "^[^A-Za-z0-9 ]"),
        "says_after": like(f"lower({after})", "(example|sample|dummy|commit|hash|file|class|page)"),
        "called": like(after, "^[.(]"),
    }


def features_py(cand: str, before: str, after: str, source: str) -> list[float]:
    """The same for one labelled finding, for training."""
    import re

    n = len(cand)
    share = lambda p, x: (len(x) - len(re.sub(p, "", x))) / len(x)
    runs = cand
    for p, to in (("[0-9]+", "0"), ("[a-z]+", "a"), ("[A-Z]+", "A"), ("[_+/=-]+", "-")):
        runs = re.sub(p, to, runs)
    low, has = before.lower(), lambda p, x: float(bool(re.search(p, x)))
    is_path = re.search("/[a-z]+/", cand) or re.search("(test|example|fixture|sample)", (source or "").lower())
    return [
        float(n), len(runs) / n, share("[0-9]", cand), share("[A-Z]", cand), share("[a-z]", cand), share("[_+/=-]", cand), share("[0-9a-f]", cand), share("[^A-Za-z0-9_+/=-]", cand), share(WORDS, cand.lower()),
        float(len(re.sub("[a-z]{4,}", "", cand))), float(bool(is_path)), has(PLACEHOLDER, cand.lower()), has(KEYWORD, low), has(KEYWORD + "[a-z_ -]*[ :=]+.?$", low), has(HASHES + "[^ ]{0,3}[ :=]*.?$", low),
        has("[^A-Za-z0-9 ]$", before), has("^[^A-Za-z0-9 ]", after), has("(example|sample|dummy|commit|hash|file|class|page)", after.lower()), has("^[.(]", after),
    ]


def labelled_findings(n: int = 4000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """(candidate, before, after, source, label): findings with their label, made from the shapes of public token formats, of passwords, and
    of what looks like them: names in code, paths, hashes, ids, placeholders, words. The hand-made ones of the tests aren't among them."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    b62, hexes, words = string.ascii_letters + string.digits, "0123456789abcdef", WORDS[1:-1].split("|")
    syll = ["the", "and", "tion", "ing", "er", "le", "aux", "mente", "cion", "ung", "ver", "heit", "ous", "re", "on"]
    made = lambda: "".join(r.choice(syll) for _ in range(r.randint(1, 3)))
    word = lambda: r.choice(words) if r.random() < 0.6 else made()
    lead = lambda: " ".join(word() for _ in range(4)) + " "
    names = ["token", "api_key", "secret", "password", "auth_token", "access_key", "SECRET_KEY", "client_secret", "private_key", "DB_PASSWORD", "passphrase", "pwd", "key"]
    joins = [' = "', "=", ": ", " = '", ': "', '": "', ":", " => "]
    asked = lambda: r.choice(["", "my_", "app.", "db-"]) + r.choice(names) + r.choice(joins)
    title = lambda k: "".join(r.choice(words).title() for _ in range(k))
    secret = [
        (lambda: pick(hexes, r.choice((32, 40, 64))), True), (lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), False), (lambda: "ghp_" + pick(b62, 36), False), (lambda: pick(b62 + "+/", r.choice((24, 40))), True),
        (lambda: "sk-" + pick(b62, r.choice((32, 48))), False), (lambda: pick(b62, r.choice((20, 32))) + "==", True), (lambda: pick(b62, r.randint(8, 16)), True), (lambda: word() + pick(string.digits, r.randint(1, 4)) + pick("!@#%&*", r.randint(0, 2)), True),
        (lambda: "".join(r.choice(words) for _ in range(r.randint(3, 5))), True), (lambda: pick(b62 + "!@#%^&*.?", r.randint(8, 24)), True), (lambda: word().title() + pick(b62, r.randint(3, 6)), True), (lambda: "-".join(r.choice(words) for _ in range(4)), True),
    ]
    other = [
        (lambda: "".join(r.choice(syll) for _ in range(r.randint(5, 9))), ""), (lambda: "/".join(word() for _ in range(r.randint(3, 5))) + "/" + word(), ""), (lambda: "-".join(word() for _ in range(4)) + str(r.randint(1, 99)), ""), (lambda: pick(string.digits, r.choice((16, 18))), ""),
        (lambda: pick(hexes, r.choice((32, 40, 64))), "hash"), (lambda: "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), "id"), (lambda: r.choice(["x", "0", "A", "*", "."]) * r.randint(6, 40), "asked"), (lambda: r.choice(["your_", "example_", "<", "my-sample-"]) + r.choice(names) + r.choice(["_here", "_example", ">", str(r.randint(1, 9))]), "asked"),
        (lambda: title(r.randint(3, 5)) + r.choice(["", "2", "V3"]), ""), (lambda: title(1).lower() + title(r.randint(2, 4)) + r.choice(["", "2"]), "code"), (lambda: "_".join(r.choice(words) for _ in range(r.randint(3, 5))), "code"), (lambda: "${" + r.choice(names) + "}", "asked"),
        (lambda: r.choice(["os.environ", "process.env", "config", "getenv", "settings", "request"]) + "." + r.choice(words), "asked"), (lambda: word() if len(w := word()) < 6 else w, "said"), (lambda: r.choice(["required", "string", "optional", "undefined", "default", "nothing", "missing", "invalid"]), "said"),
    ]
    out = []
    for i in range(n):
        if i % 2:
            shape, named = r.choice(secret)
            cand = shape()
            before = lead() + (asked() if named or r.random() < 0.6 else "")
            after = r.choice(['"', "'", " ", "", "\n", '",', "';"]) + " " + word()
        else:
            shape, where = r.choice(other)
            cand = shape()
            hashed = r.choice(["commit ", "sha256: ", 'md5 = "', "checksum=", "digest: ", "revision ", "hash: ", "key: ", "blob "])
            before = lead() + {"hash": hashed, "id": r.choice(["uuid: ", "", 'id = "']), "asked": asked(), "code": r.choice(["key = ", "new ", "", "return ", "private "]), "said": r.choice(["the key: ", "key: ", "token: ", "access: ", "password: ", "auth = "])}.get(where, "")
            after = r.choice([" " + word(), "(", ".", "\n", ", " + word(), "()"]) if where != "asked" else r.choice(['"', "'", "\n", " "])
        while len(cand) < 6:
            cand += r.choice("aeiou")
        out.append((cand, before[-BEFORE:], after[:AFTER], r.choice(["src1", "blog/a", "web"] if i % 2 else ["src1", "blog/a", "tests/fixtures"]), i % 2))
    return out


def _grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator) -> tuple:
    p = round(float(y.mean()), 4)
    if depth == 0 or len(y) < 8 or p in (0.0, 1.0):
        return (p,)
    best = None
    for f in rng.choice(x.shape[1], 6, replace=False):
        for t in np.unique(np.quantile(x[:, f], [0.1, 0.25, 0.5, 0.75, 0.9])):
            left = x[:, f] <= t
            k = int(left.sum())
            if 3 <= k <= len(y) - 3:
                a, b = y[left].mean(), y[~left].mean()
                gini = k * a * (1 - a) + (len(y) - k) * b * (1 - b)
                if best is None or gini < best[0] - 1e-12:
                    best = (gini, int(f), round(float(t), 4))
    if best is None:
        return (p,)
    left = x[:, best[1]] <= best[2]
    if left.all() or not left.any():
        return (p,)
    return (best[1], best[2], _grow(x[left], y[left], depth - 1, rng), _grow(x[~left], y[~left], depth - 1, rng))


def train_forest(findings: Sequence[tuple[str, str, str, str, int]], *, trees: int = 11, depth: int = 5, seed: int = 5, most: int = 20_000) -> list[tuple]:
    """A forest of Gini trees on bootstraps of at most `most` labelled findings (the bound of what is fitted)."""
    findings = list(findings)[:most]
    x, y = np.array([features_py(*f[:4]) for f in findings]), np.array([float(f[4]) for f in findings])
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(_grow(x[rows], y[rows], depth, rng))
    return out


@functools.cache
def default_forest() -> list[tuple]:
    return train_forest(labelled_findings())


def forest_py(forest: list[tuple], row: Sequence[float]) -> float:
    total = 0.0
    for t in forest:
        while len(t) > 1:
            t = t[2] if row[t[0]] <= t[1] else t[3]
        total += t[0]
    return total / len(forest)


def forest_sql(forest: list[tuple]) -> str:
    """The forest's mean vote over columns named as FEATURES."""

    def tree(t: tuple) -> str:
        return f"CAST({t[0]} AS DOUBLE)" if len(t) == 1 else f"(CASE WHEN {FEATURES[t[0]]} <= CAST({t[1]} AS DOUBLE) THEN {tree(t[2])} ELSE {tree(t[3])} END)"

    return f"(({' + '.join(map(tree, forest))}) / CAST({len(forest)} AS DOUBLE))"


def scan_secrets(docs: DataFrame, *, forest: list[tuple] | None = None, least: float = 0.5, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, seq, candidate, before, score, is_secret) for each candidate of each row, in the order of the text (seq from 0).

    A candidate is the value of six or more characters after a name that speaks of secrets, or a run of 16 or more token characters.
    is_secret: the forest's mean vote is `least` or more. Rows with null or empty text, and rows without candidate, give none; repeated rows
    give theirs each; an empty table gives none; docs without the column `source` count as of no source.
    Texts are cut at the candidates once, so a long text costs time in proportion. No rows meet: there is no shuffle.
    """
    of = F.col(source).cast("string") if source in docs.columns else F.lit(None).cast("string")
    some = docs.filter(F.col(text).rlike(CANDIDATE)).select(F.col(key), F.col(text).alias("__t"), of.alias("__s"))
    parts = some.select(key, "__s", F.split("__t", CANDIDATE, -1).alias("__between"), F.posexplode(F.regexp_extract_all("__t", F.lit(CANDIDATE), F.lit(0))).alias("seq", "__m"))
    named = F.regexp_extract("__m", f"^{ASSIGNED}", 0)
    value = F.expr("substr(__m, length(__n) + 1)")
    rows = parts.withColumn("__n", F.when(F.col("__m").rlike(f"^{ASSIGNED}{VALUE}$"), named).otherwise("")).select(
        key, F.col("seq").cast("long").alias("seq"), value.alias("candidate"), "__s",
        F.expr(f"right(concat(element_at(__between, seq + 1), __n), {BEFORE})").alias("before"), F.expr(f"left(element_at(__between, seq + 2), {AFTER})").alias("after"),
    )
    rows = rows.withColumns({k: F.expr(v) for k, v in features_sql("candidate", "before", "after", "__s").items()})
    score = F.expr(forest_sql(forest or default_forest()))
    return rows.select(key, "seq", "candidate", "before", F.round(score, 6).alias("score")).withColumn("is_secret", F.col("score") >= least)


def scan_sql(forest: list[tuple] | None = None, least: float = 0.5) -> str:
    """scan_secrets() over `documents` in DuckDB's SQL."""
    feats = ", ".join(f"{v} AS {k}" for k, v in features_sql("candidate", "before", "after", "source", "duckdb").items())
    q = lambda x: x.replace("'", "''")
    return f"""
WITH hits AS (SELECT doc_id, source, regexp_extract_all(text, '{q(CANDIDATE)}') AS found, regexp_split_to_array(text, '{q(CANDIDATE)}') AS between_ FROM documents WHERE regexp_matches(text, '{q(CANDIDATE)}')),
seqs AS (SELECT *, unnest(range(len(found))) AS seq FROM hits),
named AS (SELECT *, CASE WHEN regexp_matches(found[seq + 1], '^{q(ASSIGNED + VALUE)}$') THEN regexp_extract(found[seq + 1], '^{q(ASSIGNED)}') ELSE '' END AS said FROM seqs),
cut AS (SELECT doc_id, source, seq, substr(found[seq + 1], length(said) + 1) AS candidate, right(between_[seq + 1] || said, {BEFORE}) AS before, left(between_[seq + 2], {AFTER}) AS after FROM named),
feats AS (SELECT *, {feats} FROM cut)
SELECT doc_id, CAST(seq AS BIGINT) AS seq, candidate, before, round({forest_sql(forest or default_forest())}, 6) AS score, round({forest_sql(forest or default_forest())}, 6) >= {least} AS is_secret FROM feats"""
