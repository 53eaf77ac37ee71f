"""Operator 2: chat formatting by schema fingerprints.

A record's nested field paths (array places left out), sorted and hashed, are its fingerprint; the fingerprint selects
a declarative mapping from that layout to canonical turns: of the mappings whose needed fields are all there the one that
covers most of the record's fields, among equals the first in the list. The template writes a turn as ``<s>role\\ntext</s>``;
inside roles and texts a backslash is doubled and every control string gets one after its first character, so no
control string survives and reading back is exact.

Defined results
- null texts and roles are empty: a message without content is an empty turn, or its tool calls as JSON where it has any.
- content in typed parts is their texts, a line each; a part that isn't text is written as JSON.
- a record of no known layout, or one that isn't JSON, is one turn of the role ``unknown`` that holds it as it is, under no
  mask; its mapping is null, so it can be found. A null record has no turns.
- turns are ordered by (turn, role, text); repeated rows give repeated turns; other columns are ignored.
- a message that lacks the mapping's fields is read by those of another layout (:data:`MESSAGES`), so that messages of several
  layouts may mix; one that has none of them becomes a turn of the role ``unknown`` that holds it as JSON.
- fields beside those of the chosen mapping (a rejected answer, a prompt that the messages repeat, ids) are no turns.
- fields that no mapping knows change neither the fingerprint nor the mapping; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Strings that no text may hold unescaped.
CONTROL = ["</s>", "<s>", "[/INST]", "[INST]"]

#: Fields of a message: role, text.
MESSAGES = [("role", "content"), ("from", "value"), ("speaker", "text"), ("role", "text"), ("role", "value")]
#: Names that stand for a role where a message isn't in the mapping's own fields.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Layouts. ``each``: an array of messages (or several, one after the other) with role and text fields; ``turns``: (role, field, ...) in order, before them.
MAPPINGS = [
    {"name": "messages", "each": "messages", "role": "role", "text": "content", "optional": ["system"], "turns": [("system", "system")]},
    {"name": "bare messages", "each": "", "role": "role", "text": "content"},
    {"name": "sharegpt", "each": "conversations", "role": "from", "text": "value", "optional": ["system"], "turns": [("system", "system")], "roles": {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}},
    {"name": "conversations of roles", "each": "conversations", "role": "role", "text": "content", "optional": ["system"], "turns": [("system", "system")]},
    {"name": "conversation", "each": "conversation", "role": "role", "text": "content", "optional": ["system"], "turns": [("system", "system")]},
    {"name": "dialog", "each": "dialog", "role": "speaker", "text": "text", "roles": {"human": "user", "bot": "assistant"}},
    {"name": "preferred messages", "each": "chosen", "role": "role", "text": "content"},
    {"name": "prompt and preferred messages", "each": ("prompt", "chosen"), "role": "role", "text": "content", "optional": ["system"], "turns": [("system", "system")]},
    {"name": "prompt and completion messages", "each": ("prompt", "completion"), "role": "role", "text": "content", "optional": ["system"], "turns": [("system", "system")]},
    {"name": "instruction", "turns": [("system", "system"), ("user", "instruction", "input"), ("assistant", "output")], "optional": ["input", "system"]},
    {"name": "instruction response", "turns": [("user", "instruction", "context"), ("assistant", "response")], "optional": ["context"]},
    {"name": "prompt completion", "turns": [("system", "system"), ("user", "prompt"), ("assistant", "completion")], "optional": ["system"]},
    {"name": "prompt response", "turns": [("system", "system"), ("user", "prompt"), ("assistant", "response")], "optional": ["system"]},
    {"name": "preferred answer", "turns": [("system", "system"), ("user", "prompt"), ("assistant", "chosen")], "optional": ["system"]},
    {"name": "question answer", "turns": [("system", "system"), ("user", "question", "context"), ("assistant", "answer")], "optional": ["system", "context"]},
    {"name": "question response", "turns": [("system", "system_prompt"), ("user", "question"), ("assistant", "response")], "optional": ["system_prompt"]},
    {"name": "inputs targets", "turns": [("user", "inputs"), ("assistant", "targets")]},
    {"name": "nested", "turns": [("user", "input.text"), ("assistant", "output.text")]},
]


def paths(value, at: str = "") -> set[str]:
    """Nested field paths of a value; places in arrays are ``[]``, an empty array is ``[0]``."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) if value else {f"{at}[0]"}
    return {at}


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def _needed(m: dict) -> list[set[str]]:
    """For each field that a mapping needs, the paths that may hold it."""
    optional = m.get("optional", [])
    out = [{f} for t in m.get("turns", []) for f in t[1:] if f not in optional]
    for each in _arrays(m):
        none, text = f"{each}[0]", f"{each}[].{m['text']}"
        out += [{f"{each}[].{m['role']}", none}, {text, f"{text}[]", f"{text}[0]", f"{text}[].text", none}]
    return out


def _arrays(m: dict) -> tuple[str, ...]:
    each = m.get("each", ())
    return (each,) if isinstance(each, str) else each


@lru_cache(1)
def known_paths() -> frozenset[str]:
    """All fields that some mapping knows."""
    return frozenset(f for m in MAPPINGS for f in [*m.get("optional", []), *(p for held in _needed(m) for p in held)])


_chosen: dict[str, dict | None] = {}


def mapping_for(found: set[str]) -> tuple[str, dict | None]:
    """(fingerprint of the known fields, the mapping that it selects)."""
    found = found & known_paths()
    fp = fingerprint(found)
    if fp not in _chosen:
        covered = [(sum(bool(held & found) for held in _needed(m)) + len(found & set(m.get("optional", []))), -k) for k, m in enumerate(MAPPINGS) if all(held & found for held in _needed(m))]
        _chosen[fp] = MAPPINGS[-max(covered)[1]] if covered else None
    return fp, _chosen[fp]


def _get(record, path: str):
    for k in path.split("."):
        record = record.get(k) if isinstance(record, dict) else None
    return record


def _text(value) -> str:
    if value is None or isinstance(value, str):
        return value or ""
    if isinstance(value, list):
        return "\n".join(x["text"] if isinstance(x, dict) and isinstance(x.get("text"), str) else _text(x) for x in value)
    return json.dumps(value, ensure_ascii=False)


def to_turns(record) -> tuple[str, str | None, list[tuple[str, str]]]:
    """(fingerprint, name of the mapping, canonical turns) of one record."""
    fp, m = mapping_for(paths(record))
    if m is None:
        return fp, None, [] if record is None else [("unknown", json.dumps(record, ensure_ascii=False))]
    turns = []
    for role, *fields in m.get("turns", []):
        held = [x for f in fields if (x := _text(_get(record, f)))]
        if held or role != "system":
            turns.append((role, "\n\n".join(held)))
    for each in _arrays(m):
        turns += [_message(x, m) for x in (_get(record, each) if each else record) or []]
    return fp, m["name"], turns


def _message(x, m: dict) -> tuple[str, str]:
    """(role, text) of one message: by the mapping's fields, else by the first other layout whose fields it has."""
    has = set(x) if isinstance(x, dict) else set()
    role, text, roles = m["role"], m["text"], m.get("roles", {})
    if text not in has and not (role in has and "tool_calls" in has):
        other = next((pair for pair in MESSAGES if has >= set(pair)), None)
        if other is None and not (role in has and has <= {role, "name", "id"}):
            return "unknown", x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
        if other is not None:
            (role, text), roles = other, ROLES
    name, said = _text(_get(x, role)), _get(x, text)
    return roles.get(name, name), _text(_get(x, "tool_calls") if said is None else said)


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<s>((?:\\.|[^\\\n])*)\n(.*?)</s>", re.S)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, spans of it under the loss mask: what assistants say)."""
    out, spans, n = [], [], 0
    for role, text in turns:
        head, body = "<s>" + escape(role).replace("\n", "\\\n") + "\n", escape(text)
        if role == "assistant":
            spans.append((n + len(head), n + len(head) + len(body)))
        out.append(head + body + "</s>")
        n += len(out[-1])
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(a), unescape(b)) for a, b in _TURN.findall(formatted)]


def format_records(records: DataFrame, id_col: str = "id", record_col: str = "record") -> DataFrame:
    """id, fingerprint, mapping, formatted, loss_spans. ``record``: a JSON text, in any known layout if it is to have turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            fps, names, texts, masks = [], [], [], []
            for raw in b.column(1).to_pylist():
                try:
                    fp, name, turns = to_turns(json.loads(raw) if raw else None)
                except (ValueError, RecursionError):
                    fp, name, turns = fingerprint(set()), None, []
                text, spans = format_turns([("unknown", raw)] if name is None and raw else turns)
                fps.append(fp)
                names.append(name)
                texts.append(text)
                masks.append([{"start": s, "end": e} for s, e in spans])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.string()), pa.array(names, pa.string()), pa.array(texts, pa.string()), pa.array(masks, span)], names=["id", "fingerprint", "mapping", "formatted", "loss_spans"])

    chosen = records.select(F.col(id_col).cast("long").alias("id"), F.col(record_col).alias("record"))
    return chosen.mapInArrow(run, "id long, fingerprint string, mapping string, formatted string, loss_spans array<struct<start:long,end:long>>")


def conversation_records(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as one JSON record of messages per conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("m"))
    message = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return grouped.select(F.col("conv_id").alias("id"), F.to_json(F.struct(message.alias("messages"))).alias("record"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted texts hold: turns, and the text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for b in batches:
            rows = []
            for i, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((i, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("id", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return read_back(format_records(conversation_records(rows.unionByName(probe))))


_ESC = r"replace(replace(replace(replace(replace({x}, '\', '\\'), '</s>', '<\/s>'), '<s>', '<\s>'), '[/INST]', '[\/INST]'), '[INST]', '[\INST]')"
SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
e AS (
  SELECT *, 3 + length({_ESC.format(x="role")}) + 1 + length({_ESC.format(x="text")}) + 4 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
