"""Parsers learned for a file format: signatures, look-up, and running one beside the data."""

from __future__ import annotations

import hashlib
import json
import subprocess
import sys
import tempfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import normalize_name, unique_names

MATCH_LEAST, NAME_BONUS, TOP = 0.45, 0.2, 2
HEAD_LINES, TOKEN_CHARS, MAX_TOKENS = 40, 24, 80
WALL_SECONDS, GRACE_SECONDS, FILE_BYTES = 120, 15, 512 << 20


def head_tokens(text: Column) -> Column:
    """The distinct tokens of the first lines, digits masked, in order; a signature needs no more of a text."""
    head = F.array_join(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, HEAD_LINES), "\n")
    words = F.transform(F.split(head, r"[\s;,|#=:]+"), lambda w: F.substring(F.regexp_replace(F.lower(w), "[0-9]+", "#"), 1, TOKEN_CHARS))
    return F.slice(F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2))), 1, MAX_TOKENS)


def name_pattern(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[0-9]+", "#")


def matching(files: DataFrame, registry: DataFrame, k: int = TOP) -> DataFrame:
    """(file_id, script_id, similarity): the k likest parsers of ``registry`` (script_id, tokens, pattern) for each of ``files`` (file_id, tokens, pattern).

    Files and parsers meet on a shared token or an equal pattern; without either the similarity is 0. Ties by script_id.
    """
    def sides(df: DataFrame, key: str) -> DataFrame:
        keys = F.concat(F.transform("tokens", lambda t: F.concat(F.lit("t"), t)), F.when(F.col("pattern").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("p"), "pattern"))))
        return df.select(F.col(key), F.size("tokens").alias(f"{key}_n"), F.explode(keys).alias("k"))

    shared = sides(files, "file_id").join(sides(registry, "script_id"), "k").groupBy("file_id", "script_id")
    met = shared.agg(F.max(F.col("file_id_n") + F.col("script_id_n")).alias("n"), F.count_if(F.col("k").startswith("t")).alias("both"), F.bool_or(F.col("k").startswith("p")).alias("same"))
    jaccard = F.when(F.col("both") > 0, F.col("both") / (F.col("n") - F.col("both"))).otherwise(0.0)
    score = F.least(F.lit(1.0), jaccard + F.when(F.col("same"), NAME_BONUS).otherwise(0.0))
    out = met.select("file_id", "script_id", F.round(score, 6).alias("similarity")).where(F.col("similarity") >= MATCH_LEAST)
    w = Window.partitionBy("file_id").orderBy(F.desc("similarity"), "script_id")
    return out.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def scoreboard(uses: DataFrame) -> DataFrame:
    """(script_id, wins, losses) from the log of uses (script_id, ok)."""
    return uses.groupBy("script_id").agg(F.count_if("ok").alias("wins"), F.count_if(~F.coalesce(F.col("ok"), F.lit(False))).alias("losses"))


def script_id(format_id: str, tokens: list[str]) -> str:
    return hashlib.sha256("|".join(("script", format_id, *sorted(tokens))).encode()).hexdigest()[:12]


def manifest_tables(out: Path) -> tuple[list[dict], list[str]]:
    """The tables that ``manifest.json`` names, and why others are left out: missing, outside the folder, unreadable or empty."""
    import pyarrow.parquet as pq

    try:
        listed = json.loads((out / "manifest.json").read_text())["tables"]
    except (OSError, ValueError, KeyError, TypeError):
        return [], ["no readable manifest"]
    good, bad = [], []
    for t in listed:
        path = (out / str(t.get("path", ""))).resolve()
        if not path.is_relative_to(out.resolve()):
            bad.append(f"{t.get('path')}: outside")
        elif not path.is_file():
            bad.append(f"{t.get('path')}: missing")
        else:
            try:
                n = pq.read_metadata(path).num_rows
            except Exception as e:  # any damage of a file that foreign code wrote
                bad.append(f"{t['path']}: {type(e).__name__}")
                continue
            (good if n else bad).append({**t, "file": str(path), "rows": n} if n else f"{t['path']}: empty")
    return good, bad


def _limits() -> None:
    import resource

    resource.setrlimit(resource.RLIMIT_CPU, (WALL_SECONDS, WALL_SECONDS))
    resource.setrlimit(resource.RLIMIT_FSIZE, (FILE_BYTES, FILE_BYTES))


def run_parser(code: str, name: str, content: bytes) -> dict:
    """Runs ``code`` on one file in a fresh folder with CPU, file and wall limits; it reads IN/ and writes OUT/ with a manifest.

    Returns ok, error, tables (name, header, rows of strings) and the hashes of code and input. This limits mistakes; it is no
    wall against hostile code.
    """
    import pyarrow.parquet as pq

    record = {"code_sha": hashlib.sha256(code.encode()).hexdigest(), "input_sha": hashlib.sha256(content).hexdigest(), "tables": [], "invalid": [], "ok": False, "error": None}
    with tempfile.TemporaryDirectory() as folder:
        home = Path(folder)
        (home / "IN").mkdir()
        (home / "OUT").mkdir()
        (source := home / "IN" / Path(name).name).write_bytes(content)
        source.chmod(0o444)
        (home / "parser.py").write_text(code)
        try:
            done = subprocess.run([sys.executable, "-I", "parser.py"], cwd=folder, env={"PATH": "/usr/bin:/bin", "HOME": folder}, capture_output=True, timeout=WALL_SECONDS + GRACE_SECONDS, preexec_fn=_limits)
        except subprocess.TimeoutExpired:
            return record | {"error": "timeout"}
        if done.returncode:
            return record | {"error": done.stderr.decode("utf-8", "replace")[-2000:]}
        tables, record["invalid"] = manifest_tables(home / "OUT")
        for t in tables:
            read = pq.read_table(t["file"])
            rows = [[None if v is None else str(v) for v in r.values()] for r in read.to_pylist()]
            record["tables"].append((normalize_name(t.get("name") or Path(t["path"]).stem), unique_names(map(normalize_name, read.column_names)), rows))
    return record | {"ok": bool(record["tables"]), "error": None if record["tables"] else "no table"}


PARSED = "path string, name string, method string, header array<string>, row_no bigint, cells array<string>, ok boolean, error string"


def replay(files: DataFrame, code: str) -> DataFrame:
    """PARSED rows of ``files`` (path, content) by one stored parser; a file that fails is one row with its error."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for pdf in frames:
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                r = run_parser(code, p.rsplit("/", 1)[-1], bytes(data))
                rows = [(p, n, "script", h, i, c, True, None) for n, h, all_rows in r["tables"] for i, c in enumerate(all_rows)]
                yield pd.DataFrame(rows if r["ok"] else [(p, None, "script", None, None, None, False, r["error"])], columns=[x.split()[0] for x in PARSED.split(", ")]).astype({"row_no": "Int64"})

    return files.select("path", "content").mapInPandas(run, PARSED)
