"""``python -m tablesmith.cli --root DIR COMMAND ..``"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .engine import Engine, differences
from .operators import mapping, provenance
from .session import session

# Commands and what each takes.
COMMANDS = {
    "ingest": "path", "status": "", "tables": "", "review": "", "links": "", "context": "", "sql": "query", "search": "query", "ask": "query",
    "targets": "path", "contract": "path", "propose-mappings": "path", "mappings": "", "approve": "id", "reject": "id", "apply-mappings": "path",
    "canonical": "", "provenance": "id", "verify": "path", "emit": "path", "attest": "path", "scripts": "", "eval": "path",
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tablesmith")
    p.add_argument("--root", required=True)
    p.add_argument("--project", default="default")
    sub = p.add_subparsers(dest="command", required=True)
    for name, arg in COMMANDS.items():
        c = sub.add_parser(name)
        if arg:
            c.add_argument(arg)
        if name == "ingest":
            c.add_argument("--force", action="store_true")
        if name == "emit":
            c.add_argument("--since")
        if name == "attest":
            c.add_argument("--key-file", required=True)
        if name == "eval":
            c.add_argument("--freeze", action="store_true")
    return p


def _print(df) -> None:
    for r in df.toLocalIterator():
        print(json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    e = Engine(session(), a.root, a.project)
    c, now = e.catalog, e.catalog.current
    if a.command == "ingest":
        print(json.dumps(vars(e.ingest(a.path, a.force))))
    elif a.command == "status":
        _print(now("documents").groupBy("status").count())
    elif a.command in ("tables", "review", "links"):
        _print(getattr(e, a.command)())
    elif a.command == "context":
        text, doc = e.context()
        Path(a.root, "context.md").write_text(text)
        Path(a.root, "context.json").write_text(json.dumps(doc, default=str))
        print(text)
    elif a.command in ("sql", "search"):
        _print(getattr(e, a.command)(a.query))
    elif a.command == "ask":
        print(e.ask(a.query).text or "no model is configured")
    elif a.command == "targets":
        for t in mapping.targets(a.path).values():
            print(t)
    elif a.command == "contract":
        import yaml

        for t in mapping.targets(a.path).values():
            print(yaml.safe_dump(mapping.contract_document(t), sort_keys=False), end="---\n")
    elif a.command == "propose-mappings":
        print(json.dumps(e.propose(mapping.targets(a.path))))
    elif a.command == "mappings":
        _print(mapping.current(c.log("mappings")))
    elif a.command in ("approve", "reject"):
        e.decide(a.id, {"approve": "approved", "reject": "rejected"}[a.command])
    elif a.command == "apply-mappings":
        print(json.dumps(e.apply(mapping.targets(a.path))))
    elif a.command in ("canonical", "scripts"):
        _print(now({"canonical": "canonicals", "scripts": "scripts"}[a.command]))
    elif a.command == "provenance":
        _print(c.lineage_of(a.id))
        _print(c.runs_for(a.id))
    elif a.command == "verify":
        found = e.verify(a.path)
        print(json.dumps(found))
        return int(found["first_break"] is not None or "changed" in found)
    elif a.command in ("emit", "attest"):
        entries = provenance.read_ledger(e.spark, e.ledger.path)
        if a.command == "emit":
            out = provenance.run_events(entries, a.since).select("event")
        else:
            out = provenance.attest(entries, provenance.SharedKey(Path(a.key_file).read_bytes())).select("envelope")
        out.write.mode("overwrite").text(a.path)
    elif a.command == "eval":
        golden, snap = Path(a.path), e.snapshot()
        if a.freeze:
            golden.write_text(json.dumps(snap, indent=1, sort_keys=True))
            return 0
        found = differences(json.loads(golden.read_text()), snap)
        print("\n".join(found))
        return int(bool(found))
    return 0


if __name__ == "__main__":
    sys.exit(main())
