"""Chat formatting: records of many layouts become canonical turns, one marked text and a loss mask.

A record is a VARIANT. Its nested field paths, without the types of scalars, are hashed; the hash selects a declarative
mapping, and the mapping's paths give the turns. Everything is DataFrame functions.

Edge cases: null texts and roles are empty strings; turns with equal numbers are ordered by role, then text; a record
with no known fingerprint keeps its row with null layout and null text; a record without turns formats to the empty
text; columns beside the id and the record are ignored. One conversation is one value: it has to fit in a row.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of roles in known layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}

TURN, TEXT, CLOSE = "<turn>", "<text>", "</turn>\n"
ESCAPES = (("\\", "\\s"), ("<", "\\l"), (">", "\\g"))  # in this order; undone in the opposite one


@dataclass(frozen=True)
class Layout:
    """Either a list of turns at one path with fields for role and text, or one path for each turn, in order."""

    name: str
    turns: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()
    optional: frozenset[str] = field(default_factory=frozenset)
    rename_roles: bool = False

    def shapes(self) -> list[str]:
        """The path strings of all records of this layout."""
        if self.turns:
            path, *names = self.turns
            return [f"OBJECT<{path}: ARRAY<OBJECT<{', '.join(f'{n}: *' for n in sorted(names))}>>>"]
        free = sorted(self.optional)
        out = []
        for use in product((False, True), repeat=len(free)):
            names = sorted({p for _, p in self.fields} - {p for p, u in zip(free, use) if not u})
            out.append(f"OBJECT<{', '.join(f'{n}: *' for n in names)}>")
        return out

    def read(self, record: Column) -> Column:
        """The record's turns: array<struct<role, text>>."""
        if self.turns:
            path, role, text = self.turns
            found = F.try_variant_get(record, f"$.{path}", f"array<struct<{role}:string,{text}:string>>")
            return F.transform(found, lambda t: turn(_role(t[role]) if self.rename_roles else t[role], t[text]))
        parts = [(r, p, F.try_variant_get(record, f"$.{p}", "string")) for r, p in self.fields]
        return F.filter(F.array(*(F.when(text.isNotNull() | F.lit(p not in self.optional), turn(F.lit(r), text)) for r, p, text in parts)), lambda t: t.isNotNull())


LAYOUTS = (
    Layout("turns", turns=("turns", "role", "text")),
    Layout("messages", turns=("messages", "role", "content"), rename_roles=True),
    Layout("conversations", turns=("conversations", "from", "value"), rename_roles=True),
    Layout("prompt", fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=frozenset({"system"})),
    Layout("response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=frozenset({"system"})),
    Layout("question", fields=(("user", "question"), ("assistant", "answer"))),
    Layout("instruction", fields=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("task", fields=(("user", "instruction"), ("assistant", "output"))),
)


def turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _role(role: Column) -> Column:
    out = role
    for old, new in ROLES.items():
        out = F.when(F.lower(role) == old, F.lit(new)).otherwise(out)
    return out


def paths(record: Column) -> Column:
    """The record's nested field paths as one text; all scalar types count as the same."""
    return F.regexp_replace(F.schema_of_variant(record), r"(?<=[:<] ?)(?:STRING|BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|BOOLEAN|VOID|DATE|TIMESTAMP_NTZ|TIMESTAMP|BINARY|DECIMAL\([0-9,]+\))(?=[,>]|$)", "*")


def fingerprint(record: Column) -> Column:
    return F.sha2(paths(record), 256)


def escaped(x: Column) -> Column:
    for old, new in ESCAPES:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def unescaped(x: Column) -> Column:
    for old, new in reversed(ESCAPES):
        x = F.replace(x, F.lit(new), F.lit(old))
    return x


def format_chats(records: DataFrame, record_id: str, record: str, layouts: tuple[Layout, ...] = LAYOUTS, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """record_id, layout, fingerprint, formatted, and loss: the formatted text's runs of code points, with whether they are learned.

    Each turn has three runs: its marks and role, its escaped text, its closing mark.
    """
    df = records.select(F.col(record_id), F.col(record).alias("record")).withColumn("fingerprint", fingerprint(F.col("record")))
    chosen, name = F.lit(None), F.lit(None)
    for layout in layouts:
        here = F.col("fingerprint").isin([hashlib.sha256(s.encode()).hexdigest() for s in layout.shapes()])
        chosen, name = F.when(here, layout.read(F.col("record"))).otherwise(chosen), F.when(here, F.lit(layout.name)).otherwise(name)
    df = df.select(record_id, "fingerprint", name.alias("layout"), chosen.alias("turns"))
    marked = F.transform("turns", lambda t: F.struct(t["role"].isin(*learn).alias("learned"), F.concat(F.lit(TURN), escaped(t["role"]), F.lit(TEXT)).alias("head"), escaped(t["text"]).alias("body")))
    df = df.select(record_id, "fingerprint", "layout", marked.alias("marked"))
    run = lambda n, learned: F.struct(n.cast("long").alias("chars"), learned.alias("learned"))
    return df.select(
        record_id, "fingerprint", "layout",
        F.array_join(F.transform("marked", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.flatten(F.transform("marked", lambda t: F.array(run(F.length(t["head"]), F.lit(False)), run(F.length(t["body"]), t["learned"]), run(F.lit(len(CLOSE)), F.lit(False))))).alias("loss"),
    )


def read_back(formatted: DataFrame, record_id: str) -> DataFrame:
    """record_id, layout, formatted, turns, and learned: the text under the loss mask, of formatted texts and their masks."""
    pieces = formatted.select(record_id, "layout", "formatted", "loss", F.filter(F.split("formatted", CLOSE), lambda x: x != "").alias("pieces"))
    turns = F.transform("pieces", lambda x: F.struct(unescaped(F.substring_index(F.substring(x, len(TURN) + 1, 1 << 30), TEXT, 1)).alias("role"), unescaped(F.substring_index(x, TEXT, -1)).alias("text")))
    runs = lambda i, k: F.get(F.col("loss"), i * 3 + k)
    under = F.transform("pieces", lambda x, i: F.when(runs(i, 1)["learned"], unescaped(F.substring(x, runs(i, 0)["chars"].cast("int") + 1, runs(i, 1)["chars"].cast("int")))).otherwise(""))
    return pieces.select(record_id, "layout", "formatted", turns.alias("turns"), F.array_join(under, "").alias("learned"))


def records_of(rows: DataFrame, record_id: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of turns as records of the layout "turns": record_id and record."""
    own = rows.select(F.col(record_id), F.col(order).alias("at"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    turns = F.transform(F.sort_array(F.collect_list(F.struct("at", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return own.groupBy(record_id).agg(F.to_variant_object(F.struct(turns.alias("turns"))).alias("record"))


def digests(back: DataFrame, record_id: str) -> DataFrame:
    """The op9 contract's columns of what read_back() gives."""
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        record_id,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(role || text) + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) + 20 AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
