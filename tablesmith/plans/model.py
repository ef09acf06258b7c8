"""The model as a plug-in: what the engine asks of one, the absent one, and the question loop around the guarded session."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame

from .guarded import SqlSession

MAX_TURNS, ERROR_CHARS = 7, 400


class Model(Protocol):
    available: bool

    def complete(self, prompt: str, system: str = "") -> str: ...


class NullModel:
    """No model: every step that would ask one is left out."""

    available = False

    def complete(self, prompt: str, system: str = "") -> str:
        raise RuntimeError("no model is configured")


def json_in(reply: str) -> object:
    """The first JSON value in a reply, inside a fence if there is one; ValueError without any."""
    fenced = re.search(r"```\w*\s*\n?(.*?)```", reply, re.S)
    text, reader = (fenced.group(1) if fenced else reply), json.JSONDecoder()
    for at in [0, *(m.start() for m in re.finditer(r"[{\[]", text))]:
        try:
            return reader.raw_decode(text, at + len(text[at:]) - len(text[at:].lstrip()))[0]
        except ValueError:
            continue
    raise ValueError("no JSON in the reply")


@dataclass
class Answer:
    text: str
    queries: list[str] = field(default_factory=list)
    tables: set[str] = field(default_factory=set)


def ask(model: Model, sql: SqlSession, question: str, inventory: str, search: Callable[[str], DataFrame] | None = None, turns: int = MAX_TURNS) -> Answer:
    """Lets a model query until it answers: {"sql": ..}, {"search": ..} or {"answer": ..} a turn, then one turn to answer only.

    A query that is refused or fails goes back as text. The rows of a result
    that go to the model are limited by the session; the data are not.
    """
    if not model.available:
        return Answer("")
    out, log = Answer(""), [f"Tables:\n{inventory}", f"Question: {question}"]
    for turn in range(turns + 1):
        last = turn == turns
        try:
            step = json_in(model.complete("\n\n".join([*log, "Answer now." if last else "Next step?"])))
        except ValueError as e:
            log.append(f"unreadable reply: {e}")
            continue
        if not isinstance(step, dict):
            log.append("the reply is not an object")
        elif "answer" in step or last:
            out.text = str(step.get("answer", ""))
            return out
        elif "sql" in step:
            try:
                rows = [r.asDict() for r in sql.run(step["sql"]).collect()]
                out.queries.append(step["sql"])
                out.tables |= sql.touched(step["sql"])
                log.append(f"{step['sql']}\n{json.dumps(rows, default=str)}")
            except Exception as e:  # a refused or wrong query is for the model to mend
                log.append(f"{step['sql']}\nerror: {str(e)[:ERROR_CHARS]}")
        elif "search" in step and search:
            log.append(json.dumps([r.asDict() for r in search(step["search"]).collect()], default=str))
        else:
            log.append("unknown step")
    return out
