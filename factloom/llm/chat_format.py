"""Chat formatting: heterogeneous layouts to canonical turns, one template and a loss mask.

The layout of a row is recognised by its nested field paths, over all elements of a list; a schema
fingerprint, the SHA-256 of the sorted paths, names and selects the declarative mapping that says where
roles and texts are.  Tables are fingerprinted by their columns.  A JSON payload gets the largest mapping
whose paths it holds, whatever keys stand beside them; the elements of its list are mapped one by one, by
the fingerprint of their own keys, so one list may mix layouts.  Canonical turns are written in a
template that marks every turn; control strings inside roles and texts are escaped reversibly.  A
run-length mask over the code points of the formatted text says what the loss covers: each assistant
text.  The digests read turns and loss back from the formatted text, the loss through the mask.

Null roles and texts are empty; a text that is no JSON string keeps its JSON.  Payloads use known
synonyms of roles (``human``, ``gpt``); table rows keep their roles as they are.  Turns with equal numbers
are ordered by role and text, null numbers come first; repeated rows are repeated turns; rows with a null
conversation id form one conversation.  Payloads that are null, no JSON object, of an unknown layout, or
with an element that holds neither a known role nor a known text, have no layout and no turns: none is
read in part.  A very long text is one turn.  An empty table gives an empty result; extra columns are
ignored.  A conversation is one row of the result, so its turns meet in one row by definition.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
TURNS = "array<struct<role: string, text: string>>"
_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


#: Keys of a list's elements that hold a role or a text, the preferred ones first.
ROLE_KEYS, TEXT_KEYS = ("role", "from"), ("content", "text", "value")


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``turns`` names a list whose elements have a role and a text.  Each entry of ``parts`` gives a role and
    the fields whose texts, joined by blank lines, make a turn (before those of the list).  With ``rows``
    the layout is a table of one turn a row.
    """

    name: str
    turns: str = ""
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    rows: tuple[str, str, str, str] = ()

    @property
    def paths(self) -> tuple[str, ...]:
        return tuple(sorted((*self.rows, *([f"{self.turns}[]"] if self.turns else []), *self.fields)))

    @property
    def fields(self) -> tuple[str, ...]:
        return tuple(f for _, fields in self.parts for f in fields)

    @property
    def fingerprint(self) -> str:
        return fingerprint_of(self.paths)


def fingerprint_of(paths: tuple[str, ...]) -> str:
    """SHA-256 of sorted field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


_SYSTEM = ("system", ("system",))
_LISTS = ("conversation", "conversations", "messages", "turns")
_PARTS = {
    "prompt and completion": (("user", ("prompt",)), ("assistant", ("completion",))),
    "prompt and response": (("user", ("prompt",)), ("assistant", ("response",))),
    "question and answer": (("user", ("question",)), ("assistant", ("answer",))),
    "instruction": (("user", ("instruction",)), ("assistant", ("output",))),
    "instruction with input": (("user", ("instruction", "input")), ("assistant", ("output",))),
}
MAPPINGS = (
    Mapping("turn rows", rows=("conv_id", "turn", "role", "text")),
    *(Mapping(name, turns=name) for name in _LISTS),
    *(Mapping(f"system {name}", turns=name, parts=(_SYSTEM,)) for name in _LISTS),
    *(Mapping(name, parts=parts) for name, parts in _PARTS.items()),
    *(Mapping(f"system {name}", parts=(_SYSTEM, *parts)) for name, parts in _PARTS.items()),
)
_SUBSETS = [tuple(k for k, on in zip(ROLE_KEYS + TEXT_KEYS, bits, strict=True) if on) for bits in product((False, True), repeat=len(ROLE_KEYS + TEXT_KEYS))]
#: Fingerprint of an element's known keys to the keys of its role and its text.
ELEMENTS = {fingerprint_of(keys): tuple(next((k for k in wanted if k in keys), "") for wanted in (ROLE_KEYS, TEXT_KEYS)) for keys in _SUBSETS if keys}


def _digest(paths: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(paths), "\n"), 256)


def payload_fingerprint(payload: Column) -> Column:
    """Fingerprint of the largest mapping (the first of equals) whose field paths a JSON object has; null if none."""
    lists = [F.when(F.json_array_length(F.get_json_object(payload, f"$.{name}")) > 0, F.array(F.lit(f"{name}[]"))).otherwise(F.array().cast("array<string>")) for name in _LISTS]
    paths = F.concat(F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")), *lists)
    mark = F.lit(None).cast("string")
    for m in sorted((m for m in reversed(MAPPINGS) if not m.rows), key=lambda m: len(m.paths)):
        missing = F.array_except(F.array(*[F.lit(p) for p in m.paths]), paths)
        mark = F.when(F.size(missing) == 0, m.fingerprint).otherwise(mark)
    return mark


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _canonical(role: Column, text: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in _ROLES.items() for x in pair])
    return _turn(F.coalesce(F.element_at(known, F.coalesce(role, F.lit(""))), role), text)


def _element(raw: Column) -> Column:
    """The canonical turn of one list element, by the fingerprint of its own keys; null if it has no known key."""
    known = F.array(*[F.lit(k) for k in ROLE_KEYS + TEXT_KEYS])
    keys = F.create_map(*[x for mark, pair in ELEMENTS.items() for x in (F.lit(mark), F.array(*[F.lit(k) for k in pair]))])
    found = F.element_at(keys, _digest(F.array_intersect(F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")), known)))
    values = F.from_json(raw, "map<string,string>")
    return F.when(found.isNotNull(), _canonical(F.element_at(values, found[0]), F.element_at(values, found[1])))


def payload_turns(payload: Column, mapping: Mapping) -> Column:
    """Canonical turns of a JSON object under one mapping; null if an element of its list is of no known layout."""
    kinds = [f"`{f}`: string" for f in mapping.fields] + ([f"`{mapping.turns}`: array<string>"] if mapping.turns else [])
    fields = F.from_json(payload, "struct<" + ", ".join(kinds) + ">")
    made = []
    for role, names in mapping.parts:
        texts = F.filter(F.array(*[fields[n] for n in names]), lambda t: F.coalesce(F.length(t), F.lit(0)) > 0)
        made.append((role, F.array_join(texts, "\n\n")))
    turns = F.array(*[F.struct(F.lit(role).alias("role"), text.alias("text")) for role, text in made]).cast(TURNS)
    turns = F.filter(turns, lambda t: (t["role"] != F.lit("system")) | (F.length(t["text"]) > 0))
    if mapping.turns:
        listed = F.transform(fields[mapping.turns], _element).cast(TURNS)
        return F.when(~F.exists(listed, lambda t: t.isNull()), F.concat(turns, listed))
    return turns


def payload_conversations(df: DataFrame, payload: str) -> DataFrame:
    """Add ``layout`` and ``turns`` of a JSON column; unknown layouts have null and no turns."""
    mark, none = F.col("__fingerprint"), F.array().cast(TURNS)
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in MAPPINGS:
        if not m.rows:
            layout = F.when(mark == m.fingerprint, F.lit(m.name)).otherwise(layout)
            turns = F.when(mark == m.fingerprint, payload_turns(F.col(payload), m)).otherwise(turns)
    marked = df.withColumn("__fingerprint", payload_fingerprint(F.col(payload))).withColumn("turns", turns)
    return marked.withColumn("layout", F.when(F.col("turns").isNotNull(), layout)).withColumn("turns", F.coalesce("turns", none)).drop("__fingerprint")


def row_conversations(df: DataFrame) -> DataFrame:
    """``conv_id, turns`` of a table of one turn a row, by the mapping its columns select."""
    known = {p for m in MAPPINGS if m.rows for p in m.paths}
    mark = fingerprint_of(tuple(c for c in df.columns if c in known))
    mapping = next((m for m in MAPPINGS if m.rows and m.fingerprint == mark), None)
    if mapping is None:
        raise ValueError("no mapping for columns " + ", ".join(df.columns))
    key, order, role, text = mapping.rows
    rows = df.select(F.col(key).cast("long").alias("conv_id"), F.struct(F.col(order).alias("order"), _turn(F.col(role), F.col(text)).alias("turn")).alias("row"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return grouped.select("conv_id", F.transform("rows", lambda r: r["turn"]).cast(TURNS).alias("turns"))


def escape(text: Column) -> Column:
    """Backslashes doubled, then every ``<|`` parted by one: no control string is left."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """The text that ``escape`` was given."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """As ``escape``, and on one line."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def format_turns(df: DataFrame, turns: str = "turns") -> DataFrame:
    """Add ``formatted`` and its ``loss_mask``, runs of (chars, trained) that cover it."""
    written = F.transform(turns, lambda t: F.struct(escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == TRAINED_ROLE).alias("trained")))
    text = F.array_join(F.transform("__written", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), "")
    runs = F.flatten(
        F.transform(
            "__written",
            lambda t: F.array(
                F.struct((F.length(t["role"]) + len(START) + 1).alias("chars"), F.lit(False).alias("trained")),
                F.struct(F.length(t["text"]).alias("chars"), t["trained"].alias("trained")),
                F.struct(F.lit(len(END) + 1).alias("chars"), F.lit(False).alias("trained")),
            ),
        )
    )
    return df.withColumn("__written", written).withColumn("formatted", text).withColumn("loss_mask", runs).drop("__written")


def read_turns(formatted: Column) -> Column:
    """Turns read back from a formatted text."""
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)
    bodies = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p)))

    def turn(body: Column) -> Column:
        at = F.locate("\n", body)
        role = F.substring(body, F.lit(1), at - 1)
        plain = F.replace(role, F.lit("<\\n"), F.lit("\n"))
        return F.struct(unescape(plain).alias("role"), unescape(F.substring(body, at + 1, F.length(body))).alias("text"), F.substring(body, at + 1, F.length(body)).alias("raw"))

    return F.transform(bodies, turn)


def loss_text(formatted: str, mask: str) -> Column:
    """What the mask's trained runs cover of a formatted text, unescaped, run by run.

    The text is cut into turns, and each turn by its own three runs, where their lengths agree with every
    turn's; else the whole text is cut by the running sums of the lengths, which takes longer.
    """
    stop = END + "\n"
    turns = F.split(F.col(formatted), r"<\|im_end\|>\n", -1)
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)

    def run(k: Column) -> Column:
        return F.get(F.col(mask), k)

    fits = F.transform(turns, lambda t, i: F.coalesce(run(i * 3)["chars"] + run(i * 3 + 1)["chars"] + run(i * 3 + 2)["chars"] == F.length(t) + len(stop), F.lit(False)))
    aligned = (F.size(F.col(mask)) == F.size(turns) * 3) & F.forall(fits, lambda x: x)

    def pieces(t: Column, i: Column) -> Column:
        whole = F.concat(t, F.lit(stop))
        first, second, third = run(i * 3), run(i * 3 + 1), run(i * 3 + 2)
        cut = [(first, F.lit(1)), (second, first["chars"] + 1), (third, first["chars"] + second["chars"] + 1)]
        return F.concat(*[F.when(r["trained"], unescape(F.substring(whole, at, r["chars"]))).otherwise(F.lit("")) for r, at in cut])

    by_turn = F.array_join(F.transform(turns, pieces), "")
    starts = F.transform(F.col(mask), lambda r, i: F.struct(F.aggregate(F.slice(F.col(mask), F.lit(1), i), F.lit(1), lambda s, x: s + x["chars"]).alias("at"), r["chars"].alias("chars"), r["trained"].alias("on")))
    by_sums = F.array_join(F.transform(F.filter(starts, lambda r: r["on"]), lambda r: unescape(F.substring(F.col(formatted), r["at"], r["chars"]))), "")
    return F.when(aligned, by_turn).otherwise(by_sums)


def digests(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read from the output."""
    read = formatted.select("conv_id", "formatted", loss_text("formatted", "loss_mask").alias("loss"), read_turns(F.col("formatted")).alias("back"))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    made = read.select("conv_id", F.size("back").cast("long").alias("n_turns"), said.alias("said"), "loss", F.length("formatted").cast("long").alias("formatted_chars"))
    return made.select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )
