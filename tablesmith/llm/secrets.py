"""Secret scan: candidates by shape or by neighbour, false positives removed by a random forest, all in DataFrame operations.

A candidate is a long run of key characters that is not plain words, or
whatever value stands assigned to a word such as ``password``, of any length
and any characters.

The forest is trained on labelled findings with features of the candidate
(length, character transitions, dictionary coverage), its path and its
neighbouring words. Its trees become one SQL expression, so the scan stays in
the JVM and needs no shuffle.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that a run has at least, where no neighbour makes it a candidate.
MIN_CHARS = 16
#: Characters before a candidate in its own word that count as its neighbours.
LEFT_CHARS = 32
TREES, DEPTH = 12, 5
SHAPE = r"[A-Za-z0-9+/_\-.]{16,}={0,2}"
#: What plain words, of one case or with a capital first and signs between them, do not have.
NOT_PLAIN = r"[0-9]|[a-z][A-Z]|[A-Z]{2}[a-z]"

# Words beside a secret, words beside other long strings, signs of test paths, common words.
NEAR_SECRETS = "token secret password passwd pwd key apikey api auth bearer credential private access".split()
NEAR_OTHERS = "commit sha sha1 sha256 md5 checksum hash digest uuid guid revision build version card iban phone account order isbn mail url http https".split()
TEST_PATHS = "test tests spec example examples sample fixture mock docs demo".split()
COMMON_WORDS = "the and for with that this from have not are was you all can has had her his one our out day get him how man new now old see two way who boy did its let put say she too use user name value data file test example string number content index default config service client server request response message version public static return function class import package none null true false required optional placeholder changeme your here".split()

FEATURES = ("f_length", "f_digits", "f_upper", "f_hex", "f_runs", "f_distinct", "f_words", "f_near", "f_other", "f_assign", "f_quoted", "f_path", "f_prefix", "f_address", "f_symbols")


def _any(words: list[str]) -> str:
    return r"(?i)(^|[^a-z])(" + "|".join(words) + r")([^a-z]|$)"


def features(df: DataFrame) -> DataFrame:
    """Adds FEATURES to rows of (core, word, before, path): the candidate, the blank-separated word that holds it, the two words before, the path."""
    core, n = F.col("core"), F.length("core").cast("double")
    shape = F.translate(core, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "A" * 26 + "a" * 26 + "0" * 10)
    share = lambda pattern: (n - F.length(F.regexp_replace(core, pattern, ""))) / n
    left = F.concat_ws(" ", "before", F.expr(f"right(substring_index(word, core, 1), {LEFT_CHARS})"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    by_name = {
        "f_length": n,
        "f_digits": share("[0-9]"),
        "f_upper": share("[A-Z]"),
        "f_hex": share("[0-9a-f]"),
        "f_runs": F.length(F.regexp_replace(shape, r"(.)\1+", "$1")) / n,
        "f_distinct": F.size(F.array_distinct(F.split(core, ""))).cast("double"),
        "f_words": 1 - F.length(F.regexp_replace(F.lower(core), "|".join(sorted({*COMMON_WORDS, *NEAR_SECRETS}, key=lambda w: (-len(w), w))), "")) / n,
        "f_near": flag(left.rlike(_any(NEAR_SECRETS))),
        "f_other": flag(left.rlike(_any(NEAR_OTHERS))),
        "f_assign": flag(left.rlike(r"[=:]\s*[\"']?$")),
        "f_quoted": flag(F.col("word").rlike("[\"']")),
        "f_path": flag(F.col("path").rlike(_any(TEST_PATHS))),
        "f_prefix": flag(core.rlike("^(AKIA|ASIA|ghp_|gho_|xox[abp]-|sk-|sk_live|eyJ|AIza)")),
        "f_address": flag(F.col("word").rlike(r"@[A-Za-z]|://|\.[a-z]{2,}")),
        "f_symbols": share(r"[^A-Za-z0-9]"),
    }
    return df.withColumns(by_name)


def labelled_findings(n: int = 3000, seed: int = 17) -> list[tuple[str, str, str, str, int]]:
    """(core, word, before, path, y) of made-up findings: keys beside the words that announce them, and the long strings that scanners mistake for keys."""
    r = random.Random(seed)
    hexes, base = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    words = lambda k: r.choice("_-/").join(r.choice(COMMON_WORDS) for _ in range(k))
    plain = lambda: " ".join(r.choice(COMMON_WORDS) for _ in range(2))
    src, out = ["src/main.py", "app/config.yml", "src7", "deploy/env", "notes.txt"], []
    syllable = lambda: r.choice("bcdfghklmnprstvw") + r.choice("aeiou")
    name = lambda: "".join(syllable() for _ in range(r.randint(2, 4)))

    def password() -> str:
        """As people make them: syllables, case, digits and signs, or several words."""
        kind = r.randrange(4)
        if kind == 0:
            return "".join(name() for _ in range(r.randint(1, 3))) + r.choice(["", pick("0123456789", r.randint(1, 4))]) + r.choice(["", "!", "#", "$"])
        if kind == 1:
            return name().capitalize() + r.choice("!@#$%&*-_") + pick("0123456789", r.randint(1, 4)) + r.choice(["", "!", "x"])
        if kind == 2:
            return r.choice("-_.").join(name() for _ in range(r.randint(3, 5)))
        return pick(base + "!@#$%^&*?", r.randint(7, 15))

    def assigned(value: str) -> tuple[str, str]:
        near = r.choice(NEAR_SECRETS) + r.choice(["", "_" + r.choice(["key", "id", "prod"])])
        q = r.choice(['"', '"', "'", ""])
        return r.choice([(f"{q}{value}{q}", f"{near} ="), (f"{q}{value}{q}", f"{r.choice(COMMON_WORDS)} {near}:"), (f"{near}={q}{value}{q}", plain()), (f"{near}:{q}{value}{q}", plain()), (f"{q}{value}{q}", f"{near} is")])

    for _ in range(n):
        path = r.choice(src)
        if r.random() < 0.5:
            core = r.choice([lambda: pick(hexes, r.choice([32, 40, 64])), lambda: "AKIA" + pick(base[:26] + base[-10:], 16), lambda: pick(base, r.randint(20, 64)), lambda: "ghp_" + pick(base, 36), lambda: pick(base + "+/", 40) + "==", lambda: "eyJ" + ".".join(pick(base + "-_", k) for k in (20, 60, 43)), password, password, password])()
            word, before = assigned(core)
            if core.startswith(("AKIA", "ghp_", "eyJ")) and r.random() < 0.4:
                word, before = core, plain()
            y = 1
        else:
            kind = r.randrange(11)
            if kind == 0:
                core = pick(hexes, r.choice([32, 40, 64]))
                word, before = core, f"{r.choice(COMMON_WORDS)} {r.choice(NEAR_OTHERS)}" + r.choice(["", ":"])
            elif kind == 1:
                core = words(r.randint(3, 5)) + str(r.randint(1, 999))
                word, before = core, plain()
            elif kind == 2:
                core = pick("0123456789", r.randint(16, 19))
                word, before = core, plain()
            elif kind == 3:
                core = words(4)[: r.randint(16, 24)] + "9"
                word, before = f"{core}@mail.example.com", plain()
            elif kind == 4:
                core = "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12))
                word, before = core, f"{r.choice(COMMON_WORDS)} {r.choice(['uuid', 'id', 'guid'])}"
            elif kind == 5:
                core = r.choice(["example", "your", "test"]) + "_" + r.choice(["token", "key"]) + "_" + r.choice(["0123456789", "1234567890abcdef"])
                word, before, path = f'"{core}"', f"{r.choice(NEAR_SECRETS)} =", r.choice(["tests/test_api.py", "docs/example.md", *src])
            elif kind == 6:
                core = ".".join(name() for _ in range(r.randint(3, 5))) + r.choice(["", str(r.randint(1, 99))])
                word, before = r.choice([core, "https://" + core, core + "/index.html"]), plain()
            elif kind == 7:
                core = "".join(r.choice(COMMON_WORDS).capitalize() for _ in range(r.randint(3, 5)))
                word, before = core, plain()
            elif kind in (8, 9):
                core = r.choice([lambda: r.choice(COMMON_WORDS), lambda: words(2), lambda: "<" + words(2) + ">", lambda: "${" + r.choice(COMMON_WORDS).upper() + "}", lambda: str(r.randint(0, 99)), lambda: "****", lambda: "your_" + words(1) + "_here", lambda: r.choice(COMMON_WORDS) + "()"])()
                word, before = assigned(core)
            else:
                core = pick(hexes, r.choice([32, 40]))
                word, before = f"https://example.org/{core}", plain()
            y = 0
        out.append((core, word, before, path, y))
    return out


_FOREST: dict[str, str] = {}


def forest(spark: SparkSession, findings: DataFrame | None = None, seed: int = 29) -> Column:
    """The share of secrets that the trees expect, as an expression over FEATURES. findings: core, word, before, path, y; made-up ones if none are given."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    if findings is None and "default" in _FOREST:
        return F.expr(_FOREST["default"])
    rows = findings if findings is not None else spark.createDataFrame(labelled_findings(), "core string, word string, before string, path string, y int")
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(features(rows).coalesce(1)).select("x", F.col("y").cast("double").alias("y"))
    model = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=TREES, maxDepth=DEPTH, seed=seed).fit(data)

    def sql(node) -> str:
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            return repr(round(stats[1] / max(1e-9, sum(stats)), 6)) + "D"
        split = node.split()
        return f"if({FEATURES[split.featureIndex()]} <= {split.threshold()!r}D, {sql(node.leftChild())}, {sql(node.rightChild())})"

    text = "(" + " + ".join(sql(t._call_java("rootNode")) for t in model.trees) + f") / {TREES}"
    if findings is None:
        _FOREST["default"] = text
    return F.expr(text)


def scan(docs: DataFrame, score: Column, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """One row for each candidate: doc_id, word_no, run_no, n_chars, secret_sha256, score, is_secret.

    Candidates are runs of MIN_CHARS or more characters of SHAPE that are not
    plain words, and what stands in a blank-separated word behind one of NEAR_SECRETS
    and a sign of assignment (in the same word, or in the two before it), quotes
    and closing signs taken off, whatever its length. word_no counts words from
    0, run_no the candidates of a word. Null and empty texts have none. A null
    path counts as no test path. Repeated rows give their candidates again; an
    empty table an empty result; other columns are not read. The secret itself
    is not returned, only its hash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(text)
    any_near = F.lit(False)
    for w in NEAR_SECRETS:
        any_near = any_near | low.contains(w)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(path_col).cast("string").alias("path"), any_near.alias("any_near"), F.split(text, r"[\x20\x09-\x0D]+").alias("words"))
    number, word = F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i)
    near = lambda c: F.coalesce(c.rlike(_any(NEAR_SECRETS)), F.lit(False))
    ends = lambda c: F.coalesce(c.rlike(r"[=:]$|^is$"), F.lit(False))
    inside = r"(?i)(?:^|[^a-z])(?:" + "|".join(NEAR_SECRETS) + r")[^=:]*[=:]+"
    behind = lambda i: ends(word(i - 1)) & (near(word(i - 1)) | near(word(i - 2)))
    opened = lambda i: F.col("any_near") & (behind(i) | word(i).rlike(inside + "."))
    long = lambda i: (F.length(word(i)) >= MIN_CHARS) & word(i).rlike(SHAPE)
    found = F.transform(F.filter(number, lambda i: long(i) | opened(i)), lambda i: F.struct(i.alias("word_no"), word(i).alias("word"), F.concat_ws(" ", word(i - 2), word(i - 1)).alias("before"), opened(i).alias("opened")))
    out = rows.select("doc_id", "path", F.explode(found).alias("c")).select("doc_id", "path", "c.*")
    runs = F.transform(F.regexp_extract_all("word", F.lit(SHAPE), F.lit(0)), lambda r: F.regexp_replace(r, r"^\.+|\.+$", ""))
    runs = F.filter(runs, lambda r: (F.length(r) >= MIN_CHARS) & r.rlike(NOT_PLAIN))
    value = F.regexp_replace(F.regexp_replace(F.col("word"), inside, ""), r"""^[\s"'`(\[{]+|["'`)\]},;.]+$""", "")
    # Inside braces each key has its own value, and those are runs; a value that holds another assignment is none.
    value = F.when(F.col("opened") & (value != "") & ~value.rlike(r"""["'],|["']:"""), F.array(value)).otherwise(F.array().cast("array<string>"))
    overlap = F.filter(value, lambda v: ~F.exists("runs", lambda r: r.contains(v) | v.contains(r)))
    out = out.withColumn("runs", runs).select("*", F.posexplode(F.concat("runs", overlap)).alias("run_no", "core"))
    out = features(out).withColumn("score", score)
    return out.select("doc_id", "word_no", "run_no", F.length("core").alias("n_chars"), F.sha2("core", 256).alias("secret_sha256"), "score", (F.col("score") >= threshold).alias("is_secret"))
