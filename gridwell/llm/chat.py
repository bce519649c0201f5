"""Chat formatting by schema fingerprints.

A record's fingerprint is a hash of its nested field paths. It selects a
declarative mapping that says where the turns are, in order: lists of messages
with the paths of role and text, single fields with the role each stands for,
lists of earlier exchanges. All layouts so become the same turns, which one
template writes out.

The template marks a turn as ``<|turn|>role<|says|>text<|end|>``. A backslash, or
any control string of this or other common templates, gets a backslash put in
(after its first character), so no control string is left inside a text and
taking the backslashes out gives the text back.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
_ESCAPED = re.compile("|".join(map(re.escape, ("\\", *CONTROLS))))
_PUT_IN = re.compile(r"\\(.)", re.DOTALL)
_TURNS = re.compile("(.*?)".join(map(re.escape, (TURN, SAYS, END))), re.DOTALL)


def escaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def _unescape(text: str) -> str:
    r"""``\\`` is a backslash; any other backslash was put in and goes."""
    return _PUT_IN.sub(lambda m: m[1], text)


def text_of(value) -> str:
    """A text; nothing: empty; a list of parts: one after the other. Of a part that
    holds no text, and of any other value, its JSON, so nothing is lost."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "".join(map(text_of, value))
    if isinstance(value, dict) and isinstance(value.get("text"), str):
        return value["text"]
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


@dataclass(frozen=True)
class One:
    """A field that is one turn of a role. An optional one without text is none."""

    path: str
    role: str
    optional: bool = False

    def paths(self) -> tuple[str, ...]:
        return (self.path,)

    def turns(self, record) -> list[tuple[str, str]]:
        value = _at(record, self.path)
        if isinstance(value, list) and value and all(isinstance(x, dict) and {"role", "content"} <= x.keys() for x in value):
            return Many(self.path).turns(record)
        text = text_of(value)
        return [] if self.optional and not text else [(self.role, text)]

    def reads(self, record, path: str) -> bool:
        value = _at(record, self.path)
        if isinstance(value, list) and value and all(isinstance(x, dict) and {"role", "content"} <= x.keys() for x in value):
            return Many(self.path).reads(record, path)
        return _below(path, self.path)


@dataclass(frozen=True)
class Many:
    """A list of turns: objects with a role and a text, or bare texts (whose role
    is empty). Null ones are empty turns. roles: other names of roles."""

    path: str
    role: str = "role"
    text: str = "content"
    roles: tuple[tuple[str, str], ...] = ()
    optional: bool = False

    def paths(self) -> tuple[str, ...]:
        return (f"{self.path}[].{self.role}", f"{self.path}[].{self.text}")

    def turns(self, record) -> list[tuple[str, str]]:
        value = _at(record, self.path)
        names, found = dict(self.roles), []
        for x in value if isinstance(value, list) else []:
            role, text = (text_of(x.get(self.role)), text_of(x.get(self.text))) if isinstance(x, dict) else ("", text_of(x))
            found.append((names.get(role, role), text))
        return found

    def reads(self, record, path: str) -> bool:
        """Whether a leaf is in the turns: roles and texts of objects, and all of what is no object."""
        each = f"{self.path}[]"
        return path == each or path.startswith(f"{each}[]") or _below(path, f"{each}.{self.role}") or _below(path, f"{each}.{self.text}") or _empty(record, self.path, path)


@dataclass(frozen=True)
class Pairs:
    """A list of earlier exchanges: [what the user said, what the assistant said]."""

    path: str
    optional: bool = True

    def paths(self) -> tuple[str, ...]:
        return (f"{self.path}[]",)

    def turns(self, record) -> list[tuple[str, str]]:
        value, found = _at(record, self.path), []
        for x in value if isinstance(value, list) else []:
            if isinstance(x, list):
                found += [(("user", "assistant")[k % 2], text_of(t)) for k, t in enumerate(x)]
            elif isinstance(x, dict):
                found += Many("x").turns({"x": [x]})
            else:
                found.append(("user", text_of(x)))
        return found

    def reads(self, record, path: str) -> bool:
        return Many(self.path).reads(record, path)


@dataclass(frozen=True)
class Mapping:
    """Where a layout has its turns, in their order."""

    name: str
    parts: tuple

    def fit(self, paths: frozenset[str]) -> int:
        """How much of the layout is there; 0 unless all that isn't optional is."""
        there = [any(p in paths for p in part.paths()) or (isinstance(part, Many) and f"{part.path}[]" in paths) for part in self.parts]
        if not all(ok or part.optional for ok, part in zip(there, self.parts, strict=True)):
            return 0
        return sum(there)

    def turns(self, record: dict) -> list[tuple[str, str]]:
        return [t for part in self.parts for t in part.turns(record)]


def _below(path: str, top: str) -> bool:
    return path == top or path.startswith((f"{top}.", f"{top}[]"))


def _empty(record, top: str, path: str) -> bool:
    return path == top and _at(record, top) is None


def _at(record, path: str):
    for part in path.split("."):
        record = record.get(part) if isinstance(record, dict) else None
    return record


def field_paths(record, at: str = "") -> set[str]:
    """Paths of a record's leaves; ``[]`` stands for any place in a list."""
    out, left = set(), [(record, at)]
    while left:
        value, at = left.pop()
        if isinstance(value, dict) and value:
            left += [(v, f"{at}.{k}" if at else k) for k, v in value.items()]
        elif isinstance(value, list) and value:
            left += [(v, f"{at}[]") for v in value]
        else:
            out.add(f"{at}[]" if isinstance(value, list) else at)
    return out


def stems(paths) -> frozenset[str]:
    """The paths and all that lead to them."""
    return frozenset(p[:k] for p in paths for k in (*(m.start() for m in _STEPS.finditer(p)), len(p)))


_STEPS = re.compile(r"\.|\[\]")


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


SYSTEM, HISTORY = One("system", "system", optional=True), Pairs("history")
#: Names of roles in the shared layout.
SHARED = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
MAPPINGS = (
    Mapping("messages", (SYSTEM, Many("messages"))),
    Mapping("shared", (SYSTEM, Many("conversations", "from", "value", SHARED))),
    Mapping("turns", (SYSTEM, Many("turns", "role", "text"))),
    Mapping("instruction", (SYSTEM, HISTORY, One("instruction", "user"), One("input", "user", optional=True), One("output", "assistant"))),
    Mapping("question", (SYSTEM, HISTORY, One("question", "user"), One("answer", "assistant"))),
    Mapping("prompt", (SYSTEM, HISTORY, One("prompt", "user"), One("completion", "assistant"))),
    Mapping("response", (SYSTEM, HISTORY, One("prompt", "user"), One("response", "assistant"))),
)


class Layouts:
    """Finds a record's mapping by its fingerprint, and remembers it.

    A fingerprint not met before goes to the mapping of which the most is there
    (all that isn't optional must be); the first on the list among equals. None
    fits: no turns.
    """

    def __init__(self, mappings=MAPPINGS):
        self.mappings, self.known = mappings, {}

    def mapping(self, record: dict) -> tuple[str, Mapping | None]:
        paths = field_paths(record)
        key = fingerprint(paths)
        if key not in self.known:
            leading = stems(paths)
            best = max(self.mappings, key=lambda m: m.fit(leading))
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[key] = best if best.fit(leading) else None
        return key, self.known[key]


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The template's output, and the spans of it that count for the loss: the
    escaped texts of assistants' turns."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escaped(role)}{SAYS}", escaped(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parsed(output: str) -> list[tuple[str, str]]:
    """The turns, read back from the template's output."""
    return [(_unescape(r), _unescape(t)) for r, t in _TURNS.findall(output)]


#: Halves of surrogate pairs on their own.
_LONE = re.compile("[\ud800-\udfff]")


def read_back(record: str, layouts: Layouts) -> tuple:
    """What a JSON record's formatted text says when it's read back."""
    try:
        value = json.loads(record) if record else {}
    except (ValueError, RecursionError):
        value = {}
    value = value if isinstance(value, dict) else {}
    key, mapping = layouts.mapping(value)
    text, spans = formatted([(_LONE.sub("\ufffd", r), _LONE.sub("\ufffd", t)) for r, t in mapping.turns(value)] if mapping else [])
    unread = sorted(_LONE.sub("\ufffd", p) for p in field_paths(value) if p and not (mapping and any(x.reads(value, p) for x in mapping.parts)))
    turns = parsed(text)
    digest, loss = hashlib.sha256(), hashlib.sha256()
    for role, said in turns:
        digest.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
    n = 0
    for a, b in spans:
        said = _unescape(text[a:b])
        n += len(said)
        loss.update(said.encode("utf-8", "surrogatepass"))
    return text, json.dumps(spans), key, mapping.name if mapping else "", len(turns), digest.hexdigest(), n, loss.hexdigest(), len(text), json.dumps(unread, ensure_ascii=False)


FIELDS = "formatted string, loss_spans string, fingerprint string, layout string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, unread string"


def format_records(records: DataFrame, key: str = "conv_id", record: str = "record") -> DataFrame:
    """Records (JSON texts of any known layout) with their formatted text.

    A null, empty or broken record (nested too deep to be read, too), and one of
    an unknown layout, has no turns and an empty output. Null texts, roles and
    messages are empty; whatever else stands in a text's place goes in as JSON.
    Half a surrogate pair, which JSON can name and no UTF-8 text can hold, becomes
    U+FFFD. ``unread`` lists the paths of a record that its mapping has no place for,
    such as calls of tools beside a message or a second layout, as JSON.
    Texts may be of any length. Rows are independent: repeated ones stay, an
    empty table stays empty, and columns other than key and record are left out.
    """

    def make():
        layouts = Layouts()
        return lambda r: read_back(r, layouts)

    return per_text(records, [key], record, FIELDS, make)


def conversations(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as one JSON record per conversation.

    Turns go by ``turn``, null ones first, ties by role and text. Records come in
    the layouts of several sources, by a hash of conv_id among those that can
    say the conversation: lists of messages, of shared turns, of turns, of
    messages in parts; a prompt and its completion where just a user and an
    assistant speak; or earlier exchanges, an instruction and its output where
    they take turns. A conversation's turns come together in one row, since its
    digests need them in order: its length is bounded by what a row may hold
    (2 GB), and conversations with the same text are different rows. An empty
    table has no records, a null conv_id is one conversation, and columns
    besides the four are left out.
    """
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("turns"))
    named = lambda role, text, of=lambda r: r, to=lambda t: t: F.transform("turns", lambda t: F.struct(of(t["role"]).alias(role), to(t["text"]).alias(text)))
    shared = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    parts = lambda t: F.array(F.struct(F.lit("text").alias("type"), t.alias("text")))
    n = F.size("turns")
    two = F.transform("turns", lambda t, k: t["role"] == F.when(k % 2 == 0, "user").otherwise("assistant"))
    exchanged = (n % 2 == 0) & (n > 0) & F.forall(two, lambda x: x)
    at = lambda k: F.get(F.col("turns"), k)["text"]
    earlier = F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int") - 2), lambda k: F.array(at(2 * k), at(2 * k + 1)))
    record = lambda **fields: F.to_json(F.struct(*(c.alias(x) for x, c in fields.items())))
    own_names = F.exists("turns", lambda t: t["role"].isin(*(x for x, _ in SHARED)))
    which = F.pmod(F.xxhash64("conv_id"), F.lit(5))
    return turns.select(
        "conv_id",
        F.when((which == 0) & exchanged & (n == 2), record(prompt=at(F.lit(0)), completion=at(F.lit(1))))
        .when((which <= 1) & exchanged & (n > 2), record(history=earlier, instruction=at(n - 2), output=at(n - 1)))
        .when((which == 2) & ~own_names, record(conversations=named("from", "value", of=shared)))
        .when(which == 3, record(turns=named("role", "text")))
        .when(which == 4, record(messages=named("role", "content", to=parts)))
        .otherwise(record(messages=named("role", "content")))
        .alias("record"),
    )


def op3_chat(spark, sf_dir: str) -> DataFrame:
    """Every conversation formatted, with digests of what is read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    out = format_records(conversations(rows.unionByName(more)))
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "fingerprint", "layout", "unread")
