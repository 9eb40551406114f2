"""Conversations of many layouts as canonical turns, formatted under one template with a loss mask.

A layout is recognised by its schema's fingerprint: the hash of the nested field paths that some
mapping knows. The mapping, a declaration of roles and paths, then gives the turns. The template
encloses each turn in marks; marks inside texts are broken by a backslash that reading takes out.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemforge.llm import workspace

#: The marks of a turn, and other templates' control strings that texts may hold.
TURN, TEXT, TEXT_END, TURN_END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (TURN, TURN_END, TEXT, TEXT_END, "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
TRAINED = "assistant"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns: a list of messages by (list, role path, text path), or fixed
    turns by (role, text paths joined by an empty line), or table rows by (role, text)."""

    name: str
    paths: tuple[str, ...]
    messages: tuple[str, str, str] | None = None
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    row: tuple[str, str, str] | None = None


#: The layouts that are known.
MAPPINGS = (
    Mapping("messages", ("messages[].content", "messages[].role"), messages=("messages", "role", "content")),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), messages=("conversations", "from", "value")),
    Mapping("prompt_completion", ("completion", "prompt"), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt_response", ("prompt", "response"), turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("instruction", ("instruction", "output"), turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction_input", ("input", "instruction", "output"), turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("system_instruction", ("input", "instruction", "output", "system"), turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("question_answer", ("answer", "question"), turns=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("turn_rows", ("role", "text", "turn"), row=("turn", "role", "text")),
)
#: Other names of roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
KNOWN = frozenset(p for m in MAPPINGS for p in m.paths)


def fingerprint(paths: Iterable[str]) -> str:
    """The hash of the field paths that some mapping knows; others don't matter."""
    return hashlib.sha256("\n".join(sorted(KNOWN.intersection(paths))).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(m.paths): m for m in MAPPINGS}


def schema_paths(kind: T.DataType, at: str = "") -> Iterator[str]:
    """Paths of a schema's leaves."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)
    elif isinstance(kind, T.ArrayType):
        yield from schema_paths(kind.elementType, f"{at}[]")
    else:
        yield at


def value_paths(value: object, at: str = "") -> Iterator[str]:
    """Paths of a parsed record's leaves."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from value_paths(v, f"{at}.{k}" if at else k)
    elif isinstance(value, list):
        for v in value:
            yield from value_paths(v, f"{at}[]")
    else:
        yield at


def _string(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: dict) -> tuple[str, Mapping | None, list[tuple[str, str]]]:
    """(fingerprint, mapping, turns) of a parsed record; no mapping and no turns for a layout that
    is not known. Empty optional parts of a text are left out."""
    mark = fingerprint(value_paths(record))
    found = BY_FINGERPRINT.get(mark)
    if found is None:
        return mark, None, []
    if found.messages:
        items, role, text = found.messages
        return mark, found, [(ROLES.get(r := _string(x.get(role)), r), _string(x.get(text))) for x in record[items] if isinstance(x, dict)]
    if found.row:
        return mark, found, [(_string(record.get(found.row[1])), _string(record.get(found.row[2])))]
    return mark, found, [(role, "\n\n".join(t for p in paths if (t := _string(record.get(p))))) for role, paths in found.turns]


def _whole(x):
    """A parsed value whose strings and names have no half surrogate pairs."""
    if isinstance(x, str):
        return re.sub("[\ud800-\udfff]", "\ufffd", x)
    if isinstance(x, list):
        return [_whole(v) for v in x]
    return {_whole(k): _whole(v) for k, v in x.items()} if isinstance(x, dict) else x


TURNS = "conv_id long, turn long, role string, text string, mapping string, fingerprint string"


def from_records(records: DataFrame, id_column: str = "conv_id", record_column: str = "record") -> DataFrame:
    """TURNS from a column of JSON objects. A record that is null, no JSON object, nested too deeply, or of
    a layout no mapping knows gives one row without turn and mapping, its text the record itself. Half
    a surrogate pair, which no text can hold, becomes U+FFFD. An empty table gives no rows."""
    workspace.ship(records.sparkSession)
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("mapping", pa.string()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                mark, mapping, turns, record = None, None, [], None
                try:
                    record = _whole(json.loads(raw)) if raw is not None else None
                    if isinstance(record, dict):
                        mark, mapping, turns = turns_of(record)
                except (ValueError, RecursionError):  # no JSON, or nested too deeply to be read
                    pass
                if mapping is None:
                    rows.append((conv, None, None, raw, None, mark))
                first = record.get("turn") if mapping and mapping.row else 0
                rows += [(conv, first + k if isinstance(first, int) else None, role, text, mapping.name, mark) for k, (role, text) in enumerate(turns)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return records.select(F.col(id_column).cast("long"), F.col(record_column).cast("string")).mapInArrow(run, TURNS)


def from_table(table: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """TURNS from a table whose own schema is a known layout. Only rows of turns, and flat layouts,
    need no JSON; a table of messages goes through from_records. A null role or text is empty, null ids
    and turns stay null, repeated rows come out as often and rows of one turn in no order of their own.
    Columns that no layout needs are not read; an empty table gives no turns."""
    mark = fingerprint(schema_paths(table.schema))
    found = BY_FINGERPRINT.get(mark)
    if found is None:
        raise ValueError(f"no mapping for a table with {sorted(schema_paths(table.schema))}")
    if found.row is None:
        return from_records(table.select(id_column, F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns]), {"ignoreNullFields": "false"}).alias("record")), id_column)
    turn, role, text = found.row
    said = F.coalesce(F.col(role).cast("string"), F.lit(""))
    return table.select(F.col(id_column).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), said.alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.lit(found.name).alias("mapping"), F.lit(mark).alias("fingerprint"))


def escaped(text: Column) -> Column:
    """Without control strings: a backslash after the first character of each, backslashes doubled."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, formatted, loss_start, loss_length), a segment for each turn. A conversation is
    its segments one after another by turn; the loss mask covers loss_length code points from
    loss_start (from 0) of a segment, which is each assistant text. Null roles and texts count as
    empty, a null turn comes first, turns of one number stand by role and text. Rows without a
    mapping are not formatted."""
    role, text = (escaped(F.coalesce(F.col(c), F.lit(""))) for c in ("role", "text"))
    head = F.concat(F.lit(TURN), role, F.lit(TEXT))
    trained = F.col("role") == TRAINED
    return turns.where(F.col("mapping").isNotNull()).select(
        "conv_id",
        "turn",
        F.concat(head, text, F.lit(TEXT_END + TURN_END)).alias("formatted"),
        F.when(trained, F.length(head)).otherwise(0).alias("loss_start"),
        F.when(trained, F.length(text)).otherwise(0).alias("loss_length"),
    )


def parsed(segments: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, loss_text, formatted_chars) read back from segments alone."""
    whole = r"(?s)^<s>(.*?)\[INST\](.*)\[/INST\]</s>$"
    return segments.select(
        "conv_id",
        "turn",
        unescaped(F.regexp_extract("formatted", whole, 1)).alias("role"),
        unescaped(F.regexp_extract("formatted", whole, 2)).alias("text"),
        unescaped(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length"))).alias("loss_text"),
        F.length("formatted").alias("formatted_chars"),
    )


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(segments: DataFrame) -> DataFrame:
    """DIGESTS of each conversation, read back from its segments. A conversation's rows pass through
    one task in order, since a hash has to see them so, but only one row at a time is held."""
    workspace.ship(segments.sparkSession)
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        turns, loss, sums = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]

        def done() -> dict:
            return {"conv_id": now[0], "n_turns": sums[0], "turns_sha256": turns.hexdigest(), "loss_chars": sums[1], "loss_sha256": loss.hexdigest(), "formatted_chars": sums[2]}

        for b in batches:
            out = []
            for conv, _, role, text, masked, chars in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now != (conv,):
                    if now is not None:
                        out.append(done())
                    now, turns, loss, sums = (conv,), hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                loss.update(masked.encode("utf-8", "surrogatepass"))
                sums = [sums[0] + 1, sums[1] + len(masked), sums[2] + chars]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([done()], schema=schema)

    rows = parsed(segments).repartition(workspace.partitions(segments.sparkSession), "conv_id")
    return rows.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").mapInArrow(run, DIGESTS)
