"""Chat formatting: records of many layouts become canonical turns, and turns one training text with a
loss mask, from which they can be read back.

**Layouts.** A record is a row (of any columns, nested ones too) or a JSON text. Its nested field paths
that some layout knows (``messages[].role``, ``prompt``, ...) are sorted and hashed; the fingerprint
selects a declarative ``Layout``, which names the paths of roles and texts. A layout has a fingerprint
for each subset of its optional paths, so choosing is one look-up in a table that is built once from the
layouts, whatever other fields a record carries (ids, sources, scores). Null fields are absent ones. A
record that no layout fits has ``layout`` null and no turns, and stays in the result.

**Text.** A template marks the start of a turn, the end of its role and the end of the turn. Roles and
texts are escaped: backslashes are doubled, and behind the first character of every place where a control
string begins (overlapping ones too) a backslash is put, so no control string is left in them and the way
back is exact. The loss mask is a list of half-open ranges of code points of the formatted text, one for
each assistant text, empty ones included.

**Memory and skew.** Records become turns, and turns are formatted, without a shuffle. Conversations are
then dealt by key and sorted within partitions, and one pass over the sorted rows glues the turns of a
conversation: a task holds an Arrow batch and one piece. A piece ends where the conversation does, or at
the end of the turn with which it passes ``PIECE`` code points, so a conversation of any length travels in
pieces of a bounded number of turns; digests are carried over pieces. All of it is a function of the
rows alone, so lost tasks are run again with the same result.

Defined results: null texts are empty; null roles are empty roles; rows of one conversation that share a
turn number are ordered by role and text, and repeated rows are turns of their own; null turn numbers come
first; a null conversation key is a conversation of its own; conversations without turns (empty message
lists) give no row; an empty table gives no rows; columns that no layout knows may have any name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b, sha256
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

ASSISTANT = "assistant"
#: Code points from which a piece ends with its turn.
PIECE = 1 << 20
#: Names of speakers in layouts that do not use system, user and assistant; others stay as they are.
SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


# ---------------------------------------------------------------- layouts


@dataclass(frozen=True)
class Layout:
    """``turns``: (role, path of the text) of each turn, in order; then, for ``each`` list, a turn for every
    element, whose ``role`` and ``text`` are paths below it. ``optional`` paths may be missing; a turn
    whose path is missing is left out. Texts of one role that follow each other are joined by ``glue``."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, str], ...] = ()
    each: tuple[str, ...] = ()
    role: str | None = None
    text: str | None = None
    speakers: dict[str, str] = field(default_factory=dict, hash=False)
    glue: str | None = None

    def path_sets(self) -> Iterator[frozenset[str]]:
        """Every set of known paths that the layout takes; lists may be empty, which leaves their own path."""
        lists = self.each if len(self.each) == 1 else ()
        for required in (self.required, lists) if lists else (self.required,):
            free = [p for p in self.optional if required is self.required or "[]" not in p]
            for n in range(len(free) + 1):
                for some in combinations(free, n):
                    yield frozenset((*required, *some))

    def apply(self, record: dict) -> list[tuple[str, str]]:
        found = []
        for role, path in self.turns:
            if record.get(path) is None:
                continue
            text = _text(record[path])
            if self.glue is not None and found and found[-1][0] == role:
                found[-1] = (role, self.glue.join(x for x in (found[-1][1], text) if x))
            else:
                found.append((role, text))
        if self.role:  # elements of lists, or the record itself
            for e in [e for name in self.each for e in record.get(name) or []] if self.each else [record]:
                own = _text(e.get(self.role)) if isinstance(e, dict) else ""
                found.append((self.speakers.get(own, own), _text(e.get(self.text)) if isinstance(e, dict) else _text(e)))
        return found


#: A row for each turn; messages with roles; speakers with values; instructions; prompts; questions.
LAYOUTS = (
    Layout("turn_rows", ("turn",), ("role", "text"), role="role", text="text"),
    Layout("messages", ("messages[].role",), ("messages[].content", "system"), (("system", "system"),), each=("messages",), role="role", text="content"),
    Layout("conversations", ("conversations[].from",), ("conversations[].value", "system"), (("system", "system"),), each=("conversations",), role="from", text="value", speakers=SPEAKERS),
    Layout("instruction", ("instruction", "output"), ("input", "system"), (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), glue="\n\n"),
    Layout("prompt_completion", ("prompt", "completion"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", ("prompt", "response"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_messages", ("prompt[].role", "completion[].role"), ("prompt[].content", "completion[].content"), each=("prompt", "completion"), role="role", text="content"),
    Layout("question_answer", ("question", "answer"), ("context", "system"), (("system", "system"), ("user", "context"), ("user", "question"), ("assistant", "answer")), glue="\n\n"),
)


def _text(value) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str)


def field_paths(value, at: str = "") -> Iterator[str]:
    """The nested paths of the fields that are there: objects add ``.name``, lists ``[]``. Null is absent; an
    empty list is a path of its own."""
    if isinstance(value, dict):
        for name, inside in value.items():
            yield from field_paths(inside, f"{at}.{name}" if at else name)
    elif isinstance(value, list):
        if not value:
            yield at
        for inside in value:
            yield from field_paths(inside, f"{at}[]")
    elif value is not None:
        yield at


def fingerprint(paths) -> bytes:
    """A 128-bit hash of a set of paths, whatever their order."""
    return blake2b("\0".join(sorted(set(paths))).encode(), digest_size=16).digest()


class Layouts:
    """Fingerprints of layouts. Two layouts that could claim the same set of paths are an error."""

    def __init__(self, layouts: tuple[Layout, ...] = LAYOUTS):
        self.by_print: dict[bytes, Layout] = {}
        for one in layouts:
            for paths in one.path_sets():
                if self.by_print.setdefault(key := fingerprint(paths), one) is not one:
                    raise ValueError(f"{one.name} and {self.by_print[key].name} both describe {sorted(paths)}")
        self.known = frozenset(p for one in layouts for paths in one.path_sets() for p in paths)

    def of(self, record) -> Layout | None:
        if not isinstance(record, dict):
            return None
        return self.by_print.get(fingerprint(p for p in field_paths(record) if p in self.known))


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, json_col: str | None = None, into: str = "chat") -> DataFrame:
    """``records`` with ``into``, a struct (layout, turns): the name of each record's layout, and its turns as
    (role, text). A record is the
    row itself, or with ``json_col`` the JSON text in that column (null and broken texts fit no layout)."""
    table = Layouts(layouts)
    at = json_col and records.columns.index(json_col)
    kind = pa.struct([("layout", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
    left = [k for k, c in enumerate(records.columns) if c != into]
    # only columns that a layout can know are made Python objects
    heads = {re.split(r"[.\[]", p)[0] for p in table.known}
    used = [k for k, c in enumerate(records.columns) if c in heads]

    def parsed(text):
        try:
            return json.loads(text)
        except (TypeError, ValueError, RecursionError):
            return None

    def one(record) -> dict:
        layout = table.of(record)
        return {"layout": layout and layout.name, "turns": [{"role": r, "text": t} for r, t in layout.apply(record)] if layout else []}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if at is not None:
                found = [one(parsed(x)) for x in batch.column(at).to_pylist()]
            elif used:
                found = [one(x) for x in batch.select(used).to_pylist()]
            else:
                found = [one(None)] * batch.num_rows
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in left), pa.array(found, kind)], [*(batch.schema.names[k] for k in left), into])

    turn = StructType([StructField("role", StringType()), StructField("text", StringType())])
    made = StructField(into, StructType([StructField("layout", StringType()), StructField("turns", ArrayType(turn))]))
    schema = StructType([*(records.schema[k] for k in left), made])
    return records.mapInArrow(run, schema)


# ---------------------------------------------------------------- template


@dataclass(frozen=True)
class Template:
    """``open`` role ``middle`` text ``close``. Control strings have two characters and more, no backslash."""

    open: str = "### "
    middle: str = ":\n"
    close: str = "</turn>\n"
    trained: tuple[str, ...] = (ASSISTANT,)

    def __post_init__(self) -> None:
        if any(len(c) < 2 or "\\" in c for c in (self.open, self.middle, self.close.rstrip("\n"))):
            raise ValueError("control strings need two characters and no backslash")

    def _escaped(self, text: str, control: tuple[str, ...]) -> str:
        text = text.replace("\\", "\\\\")
        if not any(c in text for c in control):
            return text
        return re.sub("(?s)(?=" + "|".join(map(re.escape, control)) + ").", lambda m: m[0] + "\\", text)

    def escaped_text(self, text: str) -> str:
        return self._escaped(text, (self.open, self.close.rstrip("\n")))

    def escaped_role(self, role: str) -> str:
        return self._escaped(role, (self.open, self.close.rstrip("\n"), self.middle))

    @staticmethod
    def unescaped(text: str) -> str:
        return "\\".join(part.replace("\\", "") for part in text.split("\\\\"))

    def turn(self, role: str, text: str) -> tuple[str, int, int]:
        """(formatted turn, start and end of its text)."""
        head = f"{self.open}{self.escaped_role(role)}{self.middle}"
        inside = self.escaped_text(text)
        return f"{head}{inside}{self.close}", len(head), len(head) + len(inside)

    def read(self, formatted: str) -> Iterator[tuple[str, str]]:
        """The turns of a formatted text; what the template cannot have made raises."""
        at = 0
        while at < len(formatted):
            mid = formatted.find(self.middle, at)
            end = formatted.find(self.close, mid)
            if not formatted.startswith(self.open, at) or mid < 0 or end < 0:
                raise ValueError(f"no turn at {at}: {formatted[at : at + 60]!r}")
            yield self.unescaped(formatted[at + len(self.open) : mid]), self.unescaped(formatted[mid + len(self.middle) : end])
            at = end + len(self.close)


PIECES = "piece long, n_turns long, formatted string, loss array<struct<start: long, end: long>>"


def format_chats(turns: DataFrame, key: str, order: list[str], template: Template = Template(), piece: int = PIECE) -> DataFrame:
    """(key, PIECES) of ``turns`` (key, the columns of ``order``, role, text): the formatted text of every
    conversation with the ranges under the loss mask, in pieces of whole turns (one, unless it has more than
    ``piece`` code points)."""
    spark_key = turns.schema[key]
    kept = turns.select(key, *order, F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    names = kept.columns
    dealt = kept.repartition(key).sortWithinPartitions(key, *order, "role", "text")
    role_at, text_at = names.index("role"), names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number, count, size, parts, loss = None, 0, 0, 0, [], []
        out, waiting, begun = [], 0, False
        for batch in batches:
            for k, role, text in zip(batch.column(0).to_pylist(), batch.column(role_at).to_pylist(), batch.column(text_at).to_pylist(), strict=True):
                if begun and (k != last or size >= piece):
                    out.append((last, number, count, "".join(parts), loss))
                    waiting += size
                    number, count, size, parts, loss = (number + 1 if k == last else 0), 0, 0, [], []
                    if waiting >= piece:
                        yield made(out, batch.schema.field(0).type)
                        out, waiting = [], 0
                begun, last = True, k
                one, start, end = template.turn(role, text)
                if role in template.trained:
                    loss.append({"start": size + start, "end": size + end})
                parts.append(one)
                count, size = count + 1, size + len(one)
            kind = batch.schema.field(0).type
        if begun:
            out.append((last, number, count, "".join(parts), loss))
            yield made(out, kind)

    def made(rows: list, kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        types = [kind, pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [key, "piece", "n_turns", "formatted", "loss"])

    return dealt.mapInArrow(run, f"`{key}` {spark_key.dataType.simpleString()}, {PIECES}")


READ_BACK = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_chats(pieces: DataFrame, key: str, template: Template = Template()) -> DataFrame:
    """(key, READ_BACK) of every conversation, from its formatted text and loss mask alone: the digest of
    its turns (role, line feed, text, line feed), and length and digest of what lies under the mask."""
    dealt = pieces.select(key, "piece", "formatted", "loss").repartition(key).sortWithinPartitions(key, "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, begun, out = None, False, []
        n = loss_chars = chars = 0
        turns, under = sha256(), sha256()
        for batch in batches:
            kind = batch.schema.field(0).type
            for k, formatted, loss in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if begun and k != last:
                    out.append((last, n, turns.hexdigest(), loss_chars, under.hexdigest(), chars))
                    n = loss_chars = chars = 0
                    turns, under = sha256(), sha256()
                begun, last = True, k
                for role, text in template.read(formatted):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                for span in loss:
                    text = template.unescaped(formatted[span["start"] : span["end"]])
                    under.update(text.encode())
                    loss_chars += len(text)
                chars += len(formatted)
            if len(out) >= 1000:
                yield made(out, kind)
                out = []
        if begun:
            out.append((last, n, turns.hexdigest(), loss_chars, under.hexdigest(), chars))
            yield made(out, kind)

    def made(rows: list, kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return dealt.mapInArrow(run, f"`{key}` {pieces.schema[key].dataType.simpleString()}, {READ_BACK}")


#: A conversation whose texts look like the template's own control strings.
PLANTED, HOSTILE = -7, "\\### Assistant: </turn> ok"


def chat_report(conversations: DataFrame) -> DataFrame:
    """(conv_id, READ_BACK) of all ``conversations`` (conv_id, turn, role, text) and of one planted."""
    spark = conversations.sparkSession
    more = spark.range(1).select(F.lit(PLANTED).cast("long").alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"), F.lit(HOSTILE).alias("text"))
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(more.withColumn("turn", F.col("turn").cast("long")))
    rows = rows.withColumn("turn", F.coalesce("turn", F.lit(-(1 << 62))))  # a turn without a number is a turn
    turns = canonical_turns(rows).select("conv_id", "turn", F.posexplode("chat.turns").alias("pos", "t")).select("conv_id", "turn", "pos", "t.role", "t.text")
    return read_chats(format_chats(turns, "conv_id", ["turn", "pos"]), "conv_id")
