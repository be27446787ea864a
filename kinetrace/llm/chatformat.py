"""Chat formatting: records of many layouts become canonical turns, and turns become marked text with a loss mask.

A record's nested field paths are hashed; the fingerprint selects a declarative mapping from the registry, which says where
the conversation's id, roles and texts stand.  Formatted conversations are written to files and read back from them.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, filesystem, partitions


@dataclass(frozen=True)
class Say:
    """One turn, or one for each element of the list at ``each``: ``role`` is a path, or a fixed role if it starts with `=`.

    ``texts`` are paths whose non-empty values are joined by ``joint``; in lists, paths are those within an element.
    """

    role: str
    texts: tuple[str, ...]
    each: str | None = None
    joint: str = "\n\n"
    #: Left out where it has no text, such as a system prompt that not every record of a layout fills.
    optional: bool = False


@dataclass(frozen=True)
class Layout:
    """A mapping to canonical turns, for records with exactly the paths that it names, and any of ``extra``."""

    name: str
    id: str
    says: tuple[Say, ...]
    turn: str | None = None
    roles: dict[str, str] = field(default_factory=dict)
    extra: tuple[str, ...] = ()

    def shapes(self) -> Iterator[frozenset[str]]:
        """Sets of field paths that this mapping is for: with and without each extra path and with lists full or empty."""
        fixed = {self.id, *([self.turn] if self.turn else ())}
        lists = [s for s in self.says if s.each]
        for s in self.says:
            if not s.each:
                fixed |= {*s.texts, *(() if s.role.startswith("=") else (s.role,))}
        for n in range(len(self.extra) + 1):
            for more in itertools.combinations(self.extra, n):
                for full in itertools.product((True, False), repeat=len(lists)):
                    own = {f"{s.each}[].{p}" if has else f"{s.each}[]" for s, has in zip(lists, full, strict=True) for p in ((s.role, *s.texts) if not s.role.startswith("=") else s.texts)}
                    yield frozenset(fixed | own | set(more))


_SHARED = {"human": "user", "gpt": "assistant"}
#: Layouts that public datasets use, and rows that hold one turn each.
LAYOUTS = (
    Layout("messages", "id", (Say("role", ("content",), each="messages"),)),
    Layout("shared conversations", "id", (Say("from", ("value",), each="conversations"),), roles=_SHARED),
    Layout("prompt and completion", "id", (Say("=user", ("prompt",)), Say("=assistant", ("completion",)))),
    Layout("prompt and response", "id", (Say("=user", ("prompt",)), Say("=assistant", ("response",)))),
    Layout("instruction", "id", (Say("=user", ("instruction", "input")), Say("=assistant", ("output",)))),
    Layout("instruction alone", "id", (Say("=user", ("instruction",)), Say("=assistant", ("output",)))),
    Layout("instruction with system", "id", (Say("=system", ("system",), optional=True), Say("=user", ("instruction", "input")), Say("=assistant", ("output",)))),
    Layout("turn row", "conv_id", (Say("role", ("text",)),), turn="turn"),
    Layout("message row", "conversation.id", (Say("message.role", ("message.content",)),), turn="index"),
    Layout("shared row", "dialog", (Say("from", ("value",)),), turn="seq", roles=_SHARED),
    Layout("instruction row", "meta.id", (Say("=user", ("instruction",)),), turn="meta.turn"),
    Layout("output row", "meta.id", (Say("=assistant", ("output",)),), turn="meta.turn"),
)


def _name(key: str) -> str:
    return key if re.fullmatch(r"[^.\[\]{}\"\n]+", key) else json.dumps(key)


def field_paths(value, at: str = "") -> set[str]:
    """Paths of a JSON value's leaves: names joined by dots, `[]` after a list; empty lists and objects are leaves."""
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{at}.{_name(k)}" if at else _name(k)) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at + "{}" * isinstance(value, dict)}


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def registry(layouts: Iterable[Layout] = LAYOUTS) -> dict[str, Layout]:
    """Layouts by fingerprint; one for two layouts is an error."""
    known: dict[str, Layout] = {}
    for layout in layouts:
        for shape in layout.shapes():
            if known.setdefault(own := fingerprint(shape), layout) is not layout:
                raise ValueError(f"layouts {known[own].name!r} and {layout.name!r} have the same field paths")
    return known


def _at(value, path: str):
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: dict, layout: Layout) -> Iterator[tuple[str, str]]:
    """(role, text) of a record's turns; null roles and texts are empty."""
    for say in layout.says:
        for part in [record] if say.each is None else _at(record, say.each):
            role = say.role[1:] if say.role.startswith("=") else _text(_at(part, say.role))
            text = say.joint.join(t for t in (_text(_at(part, p)) for p in say.texts) if t)
            if text or not say.optional:
                yield layout.roles.get(role, role), text


def _parsed(payload: str | None):
    try:
        return json.loads(payload)
    except (TypeError, ValueError):
        return None


_TURN = "conv_id long, turn long, position long, role string, text string, layout string"
_TURN_ARROW = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("layout", pa.string())])


def _canonical(layouts: tuple[Layout, ...], strict: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        known, seen = registry(layouts), {}
        for batch in batches:
            out = []
            for payload in batch.column(0).to_pylist():
                record = _parsed(payload)
                paths = frozenset(field_paths(record))
                if paths not in seen:
                    seen[paths] = known.get(fingerprint(paths))
                layout = seen[paths]
                if layout is None:
                    if strict:
                        raise ValueError(f"no layout has the field paths {sorted(paths)}, fingerprint {fingerprint(paths)}")
                    continue
                conv, turn = _at(record, layout.id), layout.turn and _at(record, layout.turn)
                out += [(conv, turn, i, role, text, layout.name) for i, (role, text) in enumerate(turns_of(record, layout))]
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TURN_ARROW.types, strict=True)], schema=_TURN_ARROW)

    return run


def canonical_turns(records: DataFrame, payload: str = "payload", layouts: tuple[Layout, ...] = LAYOUTS, strict: bool = True) -> DataFrame:
    """conv_id, turn, position, role, text, layout of all turns of JSON records, whatever layout each of them has.

    A record whose fingerprint no layout has, a null or what is no JSON is an error, which names its paths; with ``strict``
    off it gives no turn, and ``census`` shows what is left out.  Null ids and turns stay null, null roles and texts are
    empty, an empty list gives no turn.  Repeated records give repeated turns.  Other columns are not read.
    """
    return records.select(F.col(f"`{payload}`").alias("payload")).mapInArrow(_canonical(tuple(layouts), strict), _TURN)


def census(records: DataFrame, payload: str = "payload", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """fingerprint, paths, layout (null: none has it) and n of the layouts that records have."""
    names = {k: v.name for k, v in registry(layouts).items()}

    def run(batches):
        for batch in batches:
            found = [sorted(field_paths(_parsed(p))) for p in batch.column(0).to_pylist()]
            marks = [fingerprint(p) for p in found]
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.string()), pa.array(found, pa.list_(pa.string())), pa.array([names.get(m) for m in marks], pa.string())], names=["fingerprint", "paths", "layout"])

    return records.select(F.col(f"`{payload}`")).mapInArrow(run, "fingerprint string, paths array<string>, layout string").groupBy("fingerprint", "paths", "layout").agg(F.count("*").alias("n"))


#: Marks of turns.  Any `<|` within a text is written with a backslash more than it has.
START, END = "<|im_start|>", "<|im_end|>\n"
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escaped(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escaped_role(role: str) -> str:
    """A role also stands on one line."""
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def parsed_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of formatted text; text that is not made of whole turns is an error."""
    at = 0
    while at < len(text):
        line, end = text.find("\n", at), text.find(END, at)
        if not text.startswith(START, at) or line < 0 or end < line:
            raise ValueError(f"no turn at character {at} of a formatted text")
        yield unescaped_role(text[at + len(START) : line]), unescaped(text[line + 1 : end])
        at = end + len(END)


#: Characters from which a conversation goes on in another row of its file.
CHUNK = 4 << 20
_FILE = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


class _Chunk:
    """Formatted turns of one conversation, and where the texts under the loss mask stand in them."""

    def __init__(self, conv: int | None, number: int = 0):
        self.conv, self.number, self.parts, self.size, self.loss = conv, number, [], 0, []

    def add(self, role: str, text: str, learnt: frozenset[str]) -> None:
        head, body = f"{START}{escaped_role(role)}\n", escaped(text)
        if role in learnt:
            self.loss.append({"start": self.size + len(head), "end": self.size + len(head) + len(body)})
        self.parts += [head, body, END]
        self.size += len(head) + len(body) + len(END)

    def row(self) -> dict:
        return {"conv_id": self.conv, "chunk": self.number, "text": "".join(self.parts), "loss": self.loss}


def _chunks(batches: Iterator[pa.RecordBatch], learnt: frozenset[str], size: int) -> Iterator[_Chunk]:
    chunk = None
    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if chunk is None or conv != chunk.conv:
                if chunk is not None:
                    yield chunk
                chunk = _Chunk(conv)
            elif chunk.size >= size:
                yield chunk
                chunk = _Chunk(conv, chunk.number + 1)
            chunk.add(role, text, learnt)
    if chunk is not None:
        yield chunk


def _write(folder: str, learnt: frozenset[str], size: int):
    def run(batches):
        chunks = _chunks(batches, learnt, size)
        first = next(chunks, None)
        if first is None:
            return
        # A name for each attempt: a repeated task never overwrites what an earlier one has reported.
        name = f"part-{uuid.uuid4().hex[:16]}.parquet"
        fs, path = filesystem(f"{folder}/{name}")
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        held, chars, n = [], 0, 0
        with fs.open_output_stream(path, compression=None) as out, pq.ParquetWriter(out, _FILE, compression="zstd") as writer:
            for chunk in itertools.chain([first], chunks):
                held.append(chunk.row())
                chars, n = chars + chunk.size, n + 1
                if chars >= 2 * CHUNK:
                    writer.write_batch(pa.RecordBatch.from_pylist(held, _FILE))
                    held, chars = [], 0
            if held:
                writer.write_batch(pa.RecordBatch.from_pylist(held, _FILE))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], names=["file", "n"])

    return run


def write_chat(turns: DataFrame, folder: str, *, learnt: Iterable[str] = ("assistant",), chunk: int = CHUNK, work: Workspace | None = None) -> DataFrame:
    """Writes canonical turns as marked text, a conversation's turns in order, and returns the files (file, n rows).

    Rows of a file are conv_id, chunk, text and loss: where, in code points of the text, texts of ``learnt`` roles stand.  A
    conversation stands in one file, in one row up to ``chunk`` characters and in more beyond, so it may be longer than memory;
    a single turn may not.  Turns are ordered by turn, null first, position, role and text; a null conv_id is one
    conversation.  Repeated turns are written as often as they come; no turns give no file.
    """
    work = work or Workspace(turns.sparkSession, "chat")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "position", "role", "text"]
    dealt = turns.select("conv_id", "turn", "position", "role", "text").repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions(*order)
    return work.write(dealt.select("conv_id", "role", "text").mapInArrow(_write(folder, frozenset(learnt), chunk), "file string, n long"), "files")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                fs, path = filesystem(file)
                with fs.open_input_file(path) as source:
                    for part in pq.ParquetFile(source).iter_batches(batch_size=8):
                        yield from part.to_pylist()

    def conversation(own: Iterator[dict]) -> tuple:
        turns, loss, n, learnt, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for row in own:
            text = row["text"]
            chars += len(text)
            for role, said in parsed_turns(text):
                turns.update(f"{role}\n{said}\n".encode())
                n += 1
            for span in row["loss"]:
                said = unescaped(text[span["start"] : span["end"]])
                loss.update(said.encode())
                learnt += len(said)
        return n, turns.hexdigest(), learnt, loss.hexdigest(), chars

    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    read = ((conv, *conversation(own)) for conv, own in itertools.groupby(rows(), key=lambda r: r["conv_id"]))
    for some in iter(lambda: list(itertools.islice(read, 1000)), []):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=names)


def read_chat(files: DataFrame) -> DataFrame:
    """Conversations as their files hold them: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Each file is parsed back into turns by its marks and read as a stream by one task.  turns_sha256 is over role, newline,
    text and newline of each turn, loss_sha256 over all texts under the loss mask.
    """
    spark = files.sparkSession
    return files.repartition(partitions(spark), "file").select("file").mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_records(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as JSON records in several row layouts, as collections of several makers hold them.

    Which one follows from the id and the role; roles that a layout would rename are left to others.
    """
    conv, turn, role, text = (F.col(c) for c in ("conv_id", "turn", "role", "text"))

    def as_json(*fields: Column) -> Column:
        return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})

    own = as_json(conv, turn, role, text)
    message = as_json(F.struct(conv.alias("id")).alias("conversation"), turn.alias("index"), F.struct(role, text.alias("content")).alias("message"))
    renamed = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    shared = as_json(conv.alias("dialog"), turn.alias("seq"), renamed.alias("from"), text.alias("value"))
    meta = F.struct(conv.alias("id"), turn).alias("meta")
    kind = F.pmod(conv, F.lit(4))
    record = (
        F.when((kind == 1) | ((kind == 3) & ~F.coalesce(role.isin("user", "assistant"), F.lit(False))), message)
        .when((kind == 2) & ~F.coalesce(role.isin(*_SHARED), F.lit(False)), shared)
        .when((kind == 3) & (role == "user"), as_json(meta, text.alias("instruction")))
        .when((kind == 3) & (role == "assistant"), as_json(meta, text.alias("output")))
        .otherwise(own)
    )
    return turns.select(record.alias("payload"))
