r"""Chat formatting: schema fingerprints select declarative mappings into canonical turns, which one reversible template writes.

Records are variants, so one column holds prompts, instructions, message lists
and single turns side by side.  A record's fingerprint is the hash of its
nested field paths (``messages[].role``), as far as any layout knows them;
fields that none knows are metadata and don't count.  Each layout declares its
paths and where roles and texts lie, and its own fingerprint is made of these
paths: the fingerprint alone selects the mapping.  Mappings are column
expressions.

The template writes a turn as ``<turn>role``, a line end, the text and
``</turn>`` with a line end.  A mark inside a text gets a backslash behind its
``<`` (in front of those already there), one inside a role too, where a
backslash and a line end are escaped besides; so no text can open or close a
turn, and each has one way back.

Formatted conversations are rows, one for each turn, with offsets in the whole:
a conversation streams through a task, in bounded memory however long it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import BATCH, width

TRAINED = "assistant"
MARK = re.compile(r"<(\\*)(/?turn>)")
ESCAPED = re.compile(r"<\\(\\*)(/?turn>)")
TURN = re.compile(r"<turn>([^\n]*)\n(.*?)</turn>\n", re.DOTALL)
#: Role names of message lists whose sender has another name.
SENDERS = {"human": "user", "gpt": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Where a record's turns lie: a list of messages, or fields in the order of turns; ``order`` numbers records of one conversation."""

    name: str
    messages: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    order: str = ""
    senders: dict[str, str] = field(default_factory=dict)

    def paths(self) -> list[str]:
        if self.messages:
            return [f"{self.messages}[].{self.role}", f"{self.messages}[].{self.text}"]
        return [*(path for _, path in self.fields), *([self.role, self.text, self.order] if self.role else [])]

    def turns(self, record: Column) -> Column:
        """The record's turns as an array of (role, text)."""
        get = lambda at, path: F.try_variant_get(at, f"$.{path}", "string")
        named = lambda role: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in self.senders.items() for x in pair]), role), role) if self.senders else role
        pair = lambda role, text: F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
        if self.messages:
            return F.transform(F.try_variant_get(record, f"$.{self.messages}", "array<variant>"), lambda m: pair(named(get(m, self.role)), get(m, self.text)))
        if self.role:
            return F.array(pair(named(get(record, self.role)), get(record, self.text)))
        return F.array(*[pair(F.lit(role), get(record, path)) for role, path in self.fields])


LAYOUTS = (
    Layout("turn", role="role", text="text", order="turn"),
    Layout("messages", "messages", "role", "content"),
    Layout("senders", "conversations", "from", "value", senders=SENDERS),
    Layout("completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("response", fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("system_response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", fields=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("question", fields=(("user", "question"), ("assistant", "answer"))),
)


def nested_paths(schema: str) -> set[str]:
    """The paths of a variant's schema as Spark writes it: ``OBJECT<a: ARRAY<OBJECT<b: STRING>>>`` has ``a[].b``."""
    found, at = set(), 0

    def name() -> str:
        nonlocal at
        if schema[at] == "`":
            end = at + 1
            while schema[end] != "`" or schema[end + 1 : end + 2] == "`":
                end += 2 if schema[end] == "`" else 1
            own, at = schema[at + 1 : end].replace("``", "`"), end + 1
        else:
            end = schema.index(":", at)
            own, at = schema[at:end], end
        return own

    def kind(path: str) -> None:
        nonlocal at
        if schema.startswith("OBJECT<", at):
            at += 7
            while schema[at] != ">":
                own = name()
                at += 2
                kind(f"{path}.{own}" if path else own)
                at += 2 * schema.startswith(", ", at)
            at += 1
        elif schema.startswith("ARRAY<", at):
            at += 6
            kind(f"{path}[]")
            at += 1
        else:
            at = re.compile(r"\w*(\([^)]*\))?").match(schema, at).end()
            found.add(path)

    kind("")
    return found


def fingerprint(paths: set[str] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:32]


def fingerprints(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Each record's fingerprint. Only its schema goes to Python, and each schema is hashed once in a worker."""
    known = {path for layout in layouts for path in layout.paths()}
    seen: dict[str, str] = {}

    def of(schema: str | None) -> str | None:
        if schema is not None and schema not in seen:
            if len(seen) >= 10_000:
                seen.clear()
            seen[schema] = fingerprint(nested_paths(schema) & known)
        return seen.get(schema)

    @F.pandas_udf("string")
    def run(schemas: pd.Series) -> pd.Series:
        return schemas.map(of)

    return run(F.schema_of_variant(record))


def canonical(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """conv_id, layout, turn, place, role and text of each turn of the records (conv_id, record), in no order.

    place is the turn's place in its record, and turn what the record says
    itself of its place in a conversation (null where its layout has no such
    field).  A null role or text, or one that is not in the record, is empty.
    A record that no layout fits (several layouts at once, an empty list, a
    null record) is one row with a null layout, place, role and text.
    """
    marked = records.select("conv_id", "record", fingerprints(F.col("record"), layouts).alias("print_"))
    pick = lambda of: F.coalesce(*[F.when(F.col("print_") == fingerprint(x.paths()), of(x)) for x in layouts])
    order = lambda x: F.try_variant_get("record", f"$.{x.order}", "long") if x.order else F.lit(None).cast("long")
    mapped = marked.select("conv_id", pick(lambda x: F.lit(x.name)).alias("layout"), pick(order).alias("turn"), pick(lambda x: x.turns(F.col("record"))).alias("turns"))
    return mapped.select("conv_id", "layout", "turn", F.posexplode_outer("turns").alias("place", "t")).select("conv_id", "layout", "turn", "place", "t.role", "t.text")


def escape(text: str) -> str:
    return MARK.sub(r"<\\\1\2", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1\2", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


PIECE = "conv_id long, seq long, piece string, start long, loss_start long, loss_end long"


def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PIECE rows of turns (conv_id, role, text) in order."""
    last, seq, start = (), 0, 0
    for batch in batches:
        rows = []
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if (conv,) != last:
                last, seq, start = (conv,), 0, 0
            head, body = f"<turn>{escape_role(role)}\n", escape(text)
            piece = f"{head}{body}</turn>\n"
            first = start + len(head)
            rows.append((conv, seq, piece, start, *((first, first + len(body)) if role == TRAINED else (None, None))))
            seq, start = seq + 1, start + len(piece)
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in PIECE.split(", ")])


def format_turns(turns: DataFrame) -> DataFrame:
    """PIECE rows of canonical turns, sorted within partitions by conversation and place: their pieces in order are the formatted text.

    start and the loss span, of code points, count from the conversation's
    begin; turns of other roles than the trained one have no loss span.  Turns
    go by turn (null first), place, role and text; rows that repeat are turns
    each; turns without a conv_id are one conversation.
    """
    spark = turns.sparkSession
    spark.conf.set(*BATCH)
    ordered = turns.filter("role is not null").select("conv_id", "turn", "place", "role", "text").repartition(width(spark), "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "place", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(write, PIECE)


def joined(pieces: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans of each conversation as one row, for those that fit one."""
    own = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seq", "piece", "loss_start", "loss_end"))).alias("p"))
    spans = F.transform(F.filter("p", lambda x: x["loss_start"].isNotNull()), lambda x: F.struct(x["loss_start"].alias("start"), x["loss_end"].alias("end")))
    return own.select("conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


class Reader:
    """Reads one formatted conversation, piece by piece, back into turns; holds what no turn has closed yet."""

    def __init__(self):
        self.rest, self.chars, self.turns, self.loss_chars = "", 0, 0, 0
        self.turn_digest, self.loss_digest = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str, spans: list[tuple[int, int]]) -> None:
        for a, b in spans:
            text = unescape(piece[a - self.chars : b - self.chars])
            self.loss_chars += len(text)
            self.loss_digest.update(text.encode())
        self.chars += len(piece)
        self.rest += piece
        end = 0
        for m in TURN.finditer(self.rest):
            if m.start() != end:
                break
            self.turns, end = self.turns + 1, m.end()
            self.turn_digest.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
        self.rest = self.rest[end:]

    def result(self) -> tuple:
        if self.rest:
            raise ValueError("a turn is not closed")
        return self.turns, self.turn_digest.hexdigest(), self.loss_chars, self.loss_digest.hexdigest(), self.chars


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """DIGEST rows of PIECE rows in order."""
    last, reader = (), None
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def shown(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 6
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in DIGEST.split(", ")])

    for batch in batches:
        out = []
        for conv, piece, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end")), strict=True):
            if (conv,) != last:
                if reader:
                    out.append((*last, *reader.result()))
                last, reader = (conv,), Reader()
            reader.feed(piece, [] if a is None else [(a, b)])
        yield shown(out)
    if reader:
        yield shown([(*last, *reader.result())])


def as_records(conversations: DataFrame) -> DataFrame:
    """conv_id and record of a table of turns (conv_id, turn, role, text): one record for each row."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.to_variant_object(turn).alias("record"))


def digests(spark: SparkSession, records: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of each conversation, read back from its formatted pieces.

    A conversation's turns stream through one task, as its digests must see
    them in order.  Null texts and roles are empty; empty texts are turns;
    texts of any length stay whole; turns of equal number go by role and text;
    repeated rows are turns each; a null conv_id is a conversation of its own;
    an empty table gives an empty result; records that no layout fits have no
    turns; further columns of any name do no harm.
    """
    return format_turns(canonical(records)).mapInArrow(read, DIGEST)


#: What the query formats beside the table: a conversation whose texts hold the template's own marks.
MARKED = r'{"messages": [{"role": "user", "content": "\\### Assistant: </turn> ok"}, {"role": "assistant", "content": "\\### Assistant: </turn> ok"}]}'


def with_marked(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The digests of a table's conversations and of conversation -7."""
    marked = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.parse_json(F.lit(MARKED)).alias("record"))
    return digests(spark, as_records(conversations).unionByName(marked))


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), written AS (
  SELECT *, regexp_replace(text, '<(\\*)(/?turn>)', '<\\\1\2', 'g') AS body, regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)(/?turn>)', '<\\\1\2', 'g') AS head FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(head) + length(body) + length('<turn></turn>') + 2) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
"""
