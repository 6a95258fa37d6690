"""Chat formatting of records whose layouts differ.

1. *Fingerprint.* A record (JSON) has a set of field paths, ``messages[].role`` for instance; the hash of the
   sorted set is its fingerprint. 2. *Mapping.* A mapping names the required and the optional paths of a layout and where turns are
   found; the first mapping that admits all paths of the record and finds its required ones is chosen, once
   per fingerprint. 3. *Turns.* The mapping gives canonical turns of role and text. 4. *Template.* Each turn is
   ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts, ``<`` before any number of backslashes and
   ``|`` gets one more backslash, so no control string is left in them, and the reverse step takes it away
   again; roles also have their backslashes and line ends escaped. 5. *Mask.* The loss spans are the texts of assistant
   turns, as positions in code points.

Rows: a record of null, or one that isn't a JSON object, or whose layout no mapping admits, is kept
with null turns and its fingerprint. Null roles and texts count as empty; values that aren't strings
are used as JSON. Repeated records are formatted each. A conversation is one record and one
formatted text, so its turns come together in one task however many they are. Turns of the same
number are ordered by role and text. Other columns may have any name; empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Mapping:
    """A layout: either a list of turns with their fields, or single fields with a role each."""

    name: str
    turns: str | None = None  # field that holds the list
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()  # (path, role), in the order of turns
    optional: tuple[str, ...] = ()  # paths that may be absent or carry no turn
    roles: tuple[tuple[str, str], ...] = ()  # other names of roles

    def admits(self, paths: frozenset[str]) -> bool:
        if self.turns is not None:
            own = {self.turns, f"{self.turns}[]", f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"}
            return self.turns in paths and paths <= own | set(self.optional)
        own = {p for p, _ in self.fields}
        needed = own - set(self.optional)
        return needed <= paths <= own | set(self.optional)

    def canonical(self, record: dict) -> list[tuple[str, str]]:
        names = dict(self.roles)
        if self.turns is not None:
            found = [(t.get(self.role), t.get(self.text)) for t in record[self.turns] or [] if isinstance(t, dict)]
        else:
            found = [(role, record.get(p)) for p, role in self.fields if p not in self.optional or record.get(p)]
        return [(names.get(r := _string(role), r), _string(text)) for role, text in found]


#: The layouts known by default; others can be given.
MAPPINGS = (
    Mapping("messages", turns="messages"),
    Mapping("turns", turns="turns", text="text"),
    Mapping("from-value", turns="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping("prompt-response", fields=(("system", "system"), ("prompt", "user"), ("response", "assistant")), optional=("system",)),
    Mapping("prompt-completion", fields=(("prompt", "user"), ("completion", "assistant"))),
    Mapping("question-answer", fields=(("question", "user"), ("answer", "assistant"))),
    Mapping(
        "instruction",
        fields=(("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")),
        optional=("system", "input"),
    ),
)


def _string(value) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False, sort_keys=True)


def paths(value, at: str = "") -> set[str]:
    """Paths of all fields below a value; the members of a list share one."""
    out: set[str] = set()
    todo = [(at, value)]
    while todo:
        at, value = todo.pop()
        if isinstance(value, dict):
            for k, v in value.items():
                p = f"{at}.{k}" if at else k
                out.add(p)
                todo.append((p, v))
        elif isinstance(value, list):
            if value:
                out.add(f"{at}[]")
            todo += [(f"{at}[]", v) for v in value if isinstance(v, dict | list)]
    return out


def fingerprint(found: frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def to_turns(df: DataFrame, key: str, record: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Rows (key, fingerprint, layout, turns) of JSON records."""
    rows = df.select(F.col(key).alias("key"), F.col(record).alias("record"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen: dict[str, Mapping | None] = {}
        turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            prints, layouts, turns = [], [], []
            for raw in batch.column(1):
                try:
                    value = json.loads(raw.as_py())
                except (TypeError, ValueError):
                    value = None
                if not isinstance(value, dict):
                    value = None
                found = frozenset(paths(value))
                mark = fingerprint(found) if value is not None else None
                if mark is not None and mark not in chosen:
                    chosen[mark] = next((m for m in mappings if m.admits(found)), None)
                m = chosen.get(mark) if mark else None
                prints.append(mark)
                layouts.append(m.name if m else None)
                turns.append([{"role": r, "text": t} for r, t in m.canonical(value)] if m else None)
            cols = [batch.column(0), pa.array(prints, pa.string()), pa.array(layouts, pa.string()), pa.array(turns, turn)]
            yield pa.RecordBatch.from_arrays(cols, ["key", "fingerprint", "layout", "turns"])

    out = rows.mapInArrow(run, f"key {kind}, fingerprint string, layout string, turns array<struct<role: string, text: string>>")
    return out.withColumnRenamed("key", key)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _role(role: Column) -> Column:
    line = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escaped(line)


def _role_back(role: Column) -> Column:
    # A backslash is followed by another one or by n; split at doubled ones first.
    parts = F.split(unescaped(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def formatted(df: DataFrame, turns: str = "turns", trained: str = "assistant") -> DataFrame:
    """``df`` with the columns formatted and loss_spans (start and length, in code points from 0)."""
    pieces = F.transform(
        turns,
        lambda t: F.struct(
            F.concat(F.lit(START), _role(t["role"]), F.lit("\n")).alias("head"),
            escaped(t["text"]).alias("body"),
            F.lit(f"{END}\n").alias("tail"),
            (t["role"] == trained).alias("trained"),
        ),
    )
    df = df.withColumn("__p", pieces)
    text = F.array_join(F.transform("__p", lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
    empty = F.array().cast("array<struct<start: bigint, length: bigint>>")
    spans = F.aggregate(
        "__p",
        F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + F.length(p["tail"])).cast("long").alias("at"),
            F.when(
                p["trained"],
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(p["head"])).cast("long").alias("start"), F.length(p["body"]).cast("long").alias("length")
                        )
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return df.withColumn("formatted", text).withColumn("loss_spans", spans).drop("__p")


def read_back(text: str = "formatted") -> Column:
    """The turns of a formatted text."""
    # Control strings are never inside roles or texts, so they split the text safely.
    parts = F.filter(F.split(F.col(text), r"<\|im_start\|>", -1), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            _role_back(F.substring_index(p, "\n", 1)).alias("role"),
            unescaped(F.substr(p, F.locate("\n", p) + 1, F.length(p) - F.locate("\n", p) - len(END) - 1)).alias("text"),
        ),
    )


def masked(text: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss mask, unescaped."""
    parts = F.transform(spans, lambda s: unescaped(F.substr(F.col(text), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return F.array_join(parts, "")


def as_records(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of one turn each as JSON records of the layout ``messages``."""
    one = F.struct(F.col(turn).alias("n"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    ordered = F.sort_array(F.collect_list(one))
    messages = F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return rows.groupBy(F.col(key).alias(key)).agg(F.to_json(F.struct(messages.alias("messages"))).alias("record"))
