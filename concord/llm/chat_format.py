r"""Chat formatting: layouts told apart by fingerprint, one reversible template.

*Layouts.* The nested field paths of a record, sorted and hashed, are its
fingerprint. A small table of declarative mappings, looked up by fingerprint,
says how to reach canonical turns ``(role, text)``: which paths hold the prompt,
the instruction, the message list, and so on. A fingerprint that no mapping has
goes to the widest mapping whose paths it holds, so further fields do no harm.
Records hold whole conversations (:func:`canonical_turns`) or a turn each
(:func:`canonical_rows`). Those of a layout that no mapping knows keep nulls and
are reported by fingerprint (:func:`unmapped`).

*Template.* A turn is ``### <role>: <text></turn>\n``. Inside roles and texts
every backslash and every ``#`` gets a backslash before it, and so does the
slash of ``</turn>`` (in roles, a colon becomes ``\c``). Escaped text can therefore
hold neither ``###`` nor ``</turn>``, and one pass over ``\x`` -> ``x`` undoes
it, whatever the text holds.

Only built-in functions are used. Texts are formatted row by row, before turns
are gathered; a conversation is one output row, as its digest runs over it.

Defined cases: a null text is an empty text, a null role an empty role; turns
are ordered by turn number (null first), ties by role and then text; repeated
rows stay repeated turns; rows without a conversation id form one conversation with a null id;
extra columns are ignored; an empty table gives no conversation.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

TURN_END = "</turn>\n"
TURNS = "array<struct<role:string,text:string>>"


# --- layouts ---------------------------------------------------------------


def fingerprint(paths: list[str]) -> str:
    """Hash of a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def schema_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Leaf paths of a typed record; ``[]`` marks a list."""
    found: list[str] = []
    for f in schema.fields:
        kind, path = f.dataType, f"{prefix}{f.name}"
        while isinstance(kind, T.ArrayType):
            kind, path = kind.elementType, f"{path}[]"
        found += schema_paths(kind, f"{path}.") if isinstance(kind, T.StructType) else [path]
    return found


def json_paths(payload: str) -> Column:
    """The leaf paths, sorted and of any depth, of the JSON objects in the column named ``payload``.

    They are read from the record's variant schema: names, opened and closed
    objects and lists, and types. Anything but an object has null paths.
    """
    kind = f"schema_of_variant(try_parse_json({payload}))"
    top = "element_at(s.open, -1)"
    return F.expr(f"""
        CASE WHEN {kind} LIKE 'OBJECT<%' THEN array_sort(array_distinct(aggregate(
          regexp_extract_all({kind}, '(`(?:[^`]|``)*`: |[^ <>,:`]+: |OBJECT<>|OBJECT<|ARRAY<|>|[A-Z_]+)', 1),
          named_struct('open', array(''), 'at', '', 'found', cast(array() AS array<string>)),
          (s, t) -> CASE
            WHEN t LIKE '%: ' THEN named_struct('open', s.open, 'at', concat({top}, trim(BOTH '`' FROM substring(t, 1, length(t) - 2))), 'found', s.found)
            WHEN t = 'OBJECT<' THEN named_struct('open', array_append(s.open, CASE WHEN s.at = '' THEN '' ELSE concat(s.at, '.') END), 'at', s.at, 'found', s.found)
            WHEN t = 'ARRAY<' THEN named_struct('open', array_append(s.open, ''), 'at', concat(s.at, '[]'), 'found', s.found)
            WHEN t = '>' THEN named_struct('open', slice(s.open, 1, size(s.open) - 1), 'at', s.at, 'found', s.found)
            ELSE named_struct('open', s.open, 'at', s.at, 'found', array_append(s.found, s.at)) END,
          s -> s.found))) END
    """)


def json_fingerprint(payload: str) -> Column:
    """The fingerprint of all paths of the JSON objects in the column named ``payload``; null for anything else."""
    return F.substring(F.sha2(F.array_join(json_paths(payload), "\n"), 256), 1, 16)


@dataclass(frozen=True)
class Mapping:
    """A layout: its field paths, and how turns are read from ``_payload``."""

    name: str
    paths: tuple[str, ...]
    turns: str

    @property
    def key(self) -> str:
        return fingerprint(list(self.paths))


def _field(path: str) -> str:
    return f"get_json_object(_payload, '$.{path}')"


def _said(*pairs: tuple[str, str]) -> str:
    """A turn for each pair; the record has its path, so a null text is an empty one."""
    turns = ", ".join(f"named_struct('role', '{role}', 'text', coalesce({text}, ''))" for role, text in pairs)
    return f"array({turns})"


def _listed(path: str, role: str, text: str) -> str:
    roles = "CASE lower({0}) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' ELSE lower({0}) END"
    return (
        f"transform(from_json({_field(path)}, 'array<map<string,string>>'),"
        f" m -> named_struct('role', {roles.format(f'm[{role!r}]')}, 'text', coalesce(m[{text!r}], '')))"
    )


MAPPINGS: tuple[Mapping, ...] = (
    Mapping("prompt", ("prompt", "completion"), _said(("user", _field("prompt")), ("assistant", _field("completion")))),
    Mapping("prompt_response", ("prompt", "response"), _said(("user", _field("prompt")), ("assistant", _field("response")))),
    Mapping("question", ("question", "answer"), _said(("user", _field("question")), ("assistant", _field("answer")))),
    Mapping("instruction", ("instruction", "output"), _said(("user", _field("instruction")), ("assistant", _field("output")))),
    Mapping(
        "instruction_input", ("instruction", "input", "output"),
        _said(("user", f"concat_ws('\\n\\n', {_field('instruction')}, nullif({_field('input')}, ''))"), ("assistant", _field("output"))),
    ),
    Mapping("messages", ("messages[].role", "messages[].content"), _listed("messages", "role", "content")),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), _listed("conversations", "from", "value")),
)

@dataclass(frozen=True)
class RowMapping:
    """A layout of one turn a record: the paths of its conversation, turn number, role and text."""

    name: str
    conv_id: str
    turn: str
    role: str
    text: str

    @property
    def paths(self) -> tuple[str, ...]:
        return self.conv_id, self.turn, self.role, self.text

    @property
    def key(self) -> str:
        return fingerprint(list(self.paths))


ROW_MAPPINGS: tuple[RowMapping, ...] = (
    RowMapping("turn", "conv_id", "turn", "role", "text"),
    RowMapping("content", "conversation_id", "index", "role", "content"),
    RowMapping("thread", "thread.id", "thread.position", "speaker", "utterance"),
    RowMapping("message", "meta.conversation", "meta.turn", "message.author.role", "message.content.text"),
)


def _chosen(mappings: tuple) -> list[tuple]:
    """(mapping, condition over ``_paths`` and ``_print``), each before those that win over it."""
    known = F.col("_print").isin(*[m.key for m in mappings])
    found = []
    for m in sorted(reversed(mappings), key=lambda m: len(m.paths)):
        held = ~known
        for p in m.paths:
            held = held & F.expr(f"exists(_paths, q -> q = '{p}' OR startswith(q, '{p}.') OR startswith(q, '{p}[]'))")
        found.append((m, held))
    return found + [(m, F.col("_print") == m.key) for m in mappings]


def _printed(records: DataFrame, payload: str) -> DataFrame:
    keyed = records.withColumn("_payload", F.col(payload)).withColumn("_paths", json_paths("_payload"))
    return keyed.withColumn("_print", F.substring(F.sha2(F.array_join("_paths", "\n"), 256), 1, 16))


def canonical_turns(records: DataFrame, payload: str = "payload", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Add ``layout`` and ``turns`` to JSON records of mixed layouts, each a whole conversation. See :func:`unmapped`."""
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m, hit in _chosen(mappings):
        layout = F.when(hit, F.lit(m.name)).otherwise(layout)
        turns = F.when(hit, F.expr(m.turns).cast(TURNS)).otherwise(turns)
    return _printed(records, payload).select(*[c for c in records.columns if c not in ("layout", "turns")], layout.alias("layout"), turns.alias("turns"))


def canonical_rows(records: DataFrame, payload: str = "payload", mappings: tuple[RowMapping, ...] = ROW_MAPPINGS) -> DataFrame:
    """``layout``, conv_id, turn, role, text of JSON records of mixed layouts, each one turn; roles and texts as they stand."""
    layout = F.lit(None).cast("string")
    for m, hit in _chosen(mappings):
        layout = F.when(hit, F.lit(m.name)).otherwise(layout)
    keyed = _printed(records, payload).withColumns({"layout": layout, "_v": F.try_parse_json("_payload")})

    def value(part: str, kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for m in mappings:
            out = F.when(F.col("layout") == m.name, F.try_variant_get("_v", f"$.{getattr(m, part)}", kind)).otherwise(out)
        return out.alias(part)

    return keyed.select("layout", value("conv_id", "bigint"), value("turn", "bigint"), value("role", "string"), value("text", "string"))


def unmapped(records: DataFrame, payload: str = "payload", mappings: tuple = MAPPINGS) -> DataFrame:
    """fingerprint, paths, n of the records that no mapping knows; null for what is no object."""
    hit = F.lit(False)
    for _, one in _chosen(mappings):
        hit = hit | F.coalesce(one, F.lit(False))
    left = _printed(records.select(F.col(payload).alias("payload")), "payload").filter(~hit)
    return left.groupBy(F.col("_print").alias("fingerprint"), F.col("_paths").alias("paths")).agg(F.count(F.lit(1)).alias("n"))


def mixed_records(turns: DataFrame) -> DataFrame:
    """Typed turns (conv_id, turn, role, text) as JSON records, ``payload``, of all row layouts, dealt by conversation; some hold a further field.

    There are no records of mixed layouts among the given tables, so they follow
    from the typed rows by arithmetic. Nulls stay fields that hold null.
    """
    conv, turn, role, text = (F.col(c) for c in ("conv_id", "turn", "role", "text"))
    by_layout = [
        F.struct(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text")),
        F.struct(text.alias("content"), role.alias("role"), turn.alias("index"), conv.alias("conversation_id")),
        F.struct(F.struct(conv.alias("id"), turn.alias("position")).alias("thread"), role.alias("speaker"), text.alias("utterance"), F.lit("web").alias("origin")),
        F.struct(F.struct(turn.alias("turn"), conv.alias("conversation")).alias("meta"), F.struct(F.struct(role.alias("role")).alias("author"), F.struct(text.alias("text")).alias("content")).alias("message")),
    ]
    kind, payload = F.pmod(F.coalesce(conv, F.lit(0)), F.lit(len(by_layout))), F.lit(None).cast("string")
    for k, shape in enumerate(by_layout):
        payload = F.when(kind == k, F.to_json(shape, {"ignoreNullFields": "false"})).otherwise(payload)
    return turns.select(payload.alias("payload"))


# --- template --------------------------------------------------------------


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\#]|(?<=<)/(?=turn>))", r"\\$1")


def escape_role(role: Column) -> Column:
    """As :func:`escape`, and free of colons, so that the first ``: `` of a turn ends its role."""
    return F.replace(escape(role), F.lit(":"), F.lit(r"\c"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\c", "$1:"))


def format_conversations(turns: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, n_turns, ``formatted`` and ``loss_spans``: [start, end) in code points of the formatted text."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    lead = F.concat(F.lit("### "), escape_role(role), F.lit(": "))
    ready = turns.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"),
        lead.alias("lead"), escape(text).alias("body"), role.isin(*trained_roles).alias("trained"),
    )
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = ready.select(
        "conv_id", "lead", "body", "trained",
        F.count(F.lit(1)).over(before).alias("at"),
        (F.coalesce(F.sum(F.length("lead") + F.length("body") + len(TURN_END)).over(before), F.lit(0)) + F.length("lead")).cast("int").alias("start"),
    )
    pieces = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "start", F.length("body").alias("size"), "trained", F.concat("lead", "body", F.lit(TURN_END)).alias("piece")))).alias("_t")
    )
    spans = "transform(filter(_t, t -> t.trained), t -> named_struct('start', t.start, 'end', t.start + t.size))"
    return pieces.select("conv_id", F.size("_t").cast("long").alias("n_turns"), F.array_join(F.col("_t.piece"), "").alias("formatted"), F.expr(spans).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Add ``turns`` (parsed and unescaped) and ``loss_texts`` (what the mask covers, unescaped)."""
    parts = F.expr(r"filter(split(formatted, '</turn>\\n', -1), p -> p <> '')")
    turns = F.transform(
        parts,
        lambda p: F.struct(
            unescape_role(F.substring(F.substring_index(p, ": ", 1), F.lit(5), F.length(p))).alias("role"),
            unescape(F.substring(p, F.length(F.substring_index(p, ": ", 1)) + F.lit(3), F.length(p))).alias("text"),
        ),
    )
    masked = F.transform(
        "loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + F.lit(1), s["end"] - s["start"]))
    )
    return formatted.withColumns({"turns": turns, "loss_texts": masked})


def digests(read: DataFrame) -> DataFrame:
    """The digest columns of a conversation, all from what was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
