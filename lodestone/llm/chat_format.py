"""Chat formatting by schema fingerprints (DataFrame functions only).

Records of unknown layout are JSON texts. A record's nested field paths (`messages[].role`) are found level by level as a
variant value, DEPTH levels deep. Those that belong to a top field which some mapping names are sorted and hashed: this is the record's schema fingerprint.
A mapping declares the paths of a layout, groups of optional ones, and the steps that give its turns; the fingerprints of all its forms
(with and without each optional group, with empty arrays) are looked up, so a layout is chosen by one hash and never guessed from values. A
fingerprint that no mapping declares leaves `mapping` null, and `unknown_layouts` counts such records by their paths.

The canonical form is an array of turns (role, text). A template writes it as one string: every turn stands between its control strings, and
control strings inside roles and texts are broken by a backslash after their first character; backslashes are doubled first, so that a
single one marks a break and everything can be read back. The loss mask gives the code points of every assistant text in the string.

Scale: one exchange, of turns by conversation, where turns come as rows; all else is done inside a record. A conversation is one
string, which Spark limits to 2 GB, and one variant value, which it limits to some tens of MB; a record beyond that has no mapping,
which the query reports as an error. Nothing reaches the driver, and nothing is broadcast.

Defined results: a null text is empty, a null role too; turns stand by number (nulls first), then by role and text, and repeated rows are turns
of their own; a null conversation id is an id of its own; a null or invalid JSON text has no mapping; a null value of an optional
field gives no turn; fields that no mapping names are passed over; an empty array has no turns; numbers and other values stand as their
JSON text; an empty table gives, in the query, the added conversation alone.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common

DEPTH = 6
TURNS = "array<struct<role:string,text:string>>"


# ---- paths and fingerprints


def field_paths(record: Column) -> Column:
    """record: variant. The distinct paths of its leaves: `a.b`, `a[]` for items, with `{}` and `[]` for empty ones. Points and
    brackets in names are escaped. What lies deeper than DEPTH counts as a leaf."""
    quoted = lambda k: F.regexp_replace(k, r"([.\[\]{}\\])", r"\\$1")
    leaf = lambda p: F.array(F.struct(p.alias("path"), F.lit(None).cast("variant").alias("v")))

    def below(n: Column) -> Column:
        fields, items = F.map_entries(F.try_variant_get(n["v"], "$", "map<string,variant>")), F.try_variant_get(n["v"], "$", "array<variant>")
        inside = F.concat(n["path"], F.lit("[]"))
        of_fields = F.transform(fields, lambda e: F.struct(F.concat(n["path"], F.lit("."), quoted(e["key"])).alias("path"), e["value"].alias("v")))
        of_items = F.transform(items, lambda x: F.struct(inside.alias("path"), x.alias("v")))
        return F.when(F.size(fields) > 0, of_fields).when(fields.isNotNull(), leaf(F.concat(n["path"], F.lit("{}")))).when(F.size(items) > 0, of_items).when(items.isNotNull(), leaf(inside)).otherwise(leaf(n["path"]))

    nodes = F.array(F.struct(F.lit("").alias("path"), record.alias("v")))
    for _ in range(DEPTH):
        nodes = F.flatten(F.transform(nodes, below))
    return F.array_sort(F.array_distinct(F.transform(nodes, lambda n: F.substring(n["path"], F.lit(2), F.length(n["path"])))))


def fingerprint(paths: Column) -> Column:
    """SHA-256 of sorted paths."""
    return F.sha2(F.array_join(paths, "\n"), 256)


# ---- mappings


@dataclass(frozen=True)
class One:
    """A turn of a fixed role from one field; none where the field is missing or null."""

    role: str
    path: str

    def turns(self, record: Column) -> Column:
        text = F.try_variant_get(record, f"$.{self.path}", "string")
        return F.when(text.isNull(), F.array().cast(TURNS)).otherwise(F.array(F.struct(F.lit(self.role).alias("role"), text.alias("text"))))

    def written(self, text: Column) -> dict[str, Column]:
        return {self.path: text}


@dataclass(frozen=True)
class Joined:
    """A turn of a fixed role from several fields, with a blank line between those that are there and not empty."""

    role: str
    paths: tuple[str, ...]

    def turns(self, record: Column) -> Column:
        texts = F.filter(F.array(*(F.try_variant_get(record, f"$.{p}", "string") for p in self.paths)), lambda t: F.coalesce(t != "", F.lit(False)))
        return F.array(F.struct(F.lit(self.role).alias("role"), F.array_join(texts, "\n\n").alias("text")))


@dataclass(frozen=True)
class Each:
    """A turn for each item of an array, in order (of a number, where `order` names one). Content may be a text or a list of parts with texts."""

    path: str
    role: str
    text: str
    order: str | None = None
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def turns(self, record: Column) -> Column:
        items = F.try_variant_get(record, f"$.{self.path}", "array<variant>")
        if self.order:
            place = lambda x: F.try_variant_get(x, f"$.{self.order}", "bigint")
            numbered = F.transform(items, lambda x, i: F.struct(place(x).alias("at"), i.alias("i")))
            items = F.transform(F.array_sort(numbered), lambda n: F.get(items, n["i"]))

        def turn(x: Column) -> Column:
            said = F.try_variant_get(x, f"$.{self.role}", "string")
            role = said
            for name, meant in self.roles.items():
                role = F.when(said == name, meant).otherwise(role)
            parts = F.transform(F.try_variant_get(x, f"$.{self.text}", "array<variant>"), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")))
            text = F.coalesce(F.array_join(parts, ""), F.try_variant_get(x, f"$.{self.text}", "string"), F.lit(""))
            return F.struct(F.coalesce(role, F.lit("")).alias("role"), text.alias("text"))

        return F.coalesce(F.transform(items, turn), F.array().cast(TURNS))

    def written(self, turns: Column) -> dict[str, Column]:
        back = {meant: name for name, meant in self.roles.items()}

        def item(t: Column, i: Column) -> Column:
            role = t["role"]
            for meant, name in back.items():
                role = F.when(t["role"] == meant, name).otherwise(role)
            number = [i.alias(self.order)] if self.order else []
            return F.struct(*number, role.alias(self.role), t["text"].alias(self.text))

        return {self.path: F.transform(turns, item)}


@dataclass(frozen=True)
class Mapping:
    """A layout: its paths, the steps that give its turns, groups of optional paths, and other paths that the same steps read."""

    name: str
    paths: tuple[str, ...]
    steps: tuple
    optional: tuple[tuple[str, ...], ...] = ()
    others: tuple[tuple[str, ...], ...] = ()

    def forms(self) -> set[tuple[str, ...]]:
        """The sorted paths of each form: optional groups or not, arrays filled or empty."""
        subsets = lambda x: itertools.chain.from_iterable(itertools.combinations(x, n) for n in range(len(x) + 1))
        arrays = sorted({p.split("[]")[0] for p in self.paths if "[]" in p})
        out = set()
        for paths, some, bare in itertools.product((self.paths, *self.others), subsets(self.optional), subsets(arrays)):
            whole = {*paths, *(p for group in some for p in group)}
            out.add(tuple(sorted({next((f"{a}[]" for a in bare if p.startswith(f"{a}[]")), p) for p in whole})))
        return out

    def tops(self) -> set[str]:
        return {re.split(r"[.\[{]", p)[0] for p in itertools.chain(self.paths, *self.optional)}

    def turns(self, record: Column) -> Column:
        return F.concat(*(s.turns(record) for s in self.steps))


_SHARE = {"human": "user", "gpt": "assistant"}
_SYSTEM = ("system",)
_ROLE, _CONTENT, _PARTS = "messages[].role", "messages[].content", ("messages[].content[].type", "messages[].content[].text")
MAPPINGS = (
    Mapping("messages", (_ROLE, _CONTENT), (One("system", "system"), Each("messages", "role", "content")), (_SYSTEM,), ((_ROLE, *_PARTS), (_ROLE, _CONTENT, *_PARTS))),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), (One("system", "system"), Each("conversations", "from", "value", roles=_SHARE)), (_SYSTEM,)),
    Mapping("turns", ("turns[].turn", "turns[].role", "turns[].text"), (Each("turns", "role", "text", order="turn"),)),
    Mapping("instruction", ("instruction", "output"), (One("system", "system"), Joined("user", ("instruction", "input")), One("assistant", "output")), (_SYSTEM, ("input",))),
    Mapping("completion", ("prompt", "completion"), (One("system", "system"), One("user", "prompt"), One("assistant", "completion")), (_SYSTEM,)),
    Mapping("response", ("prompt", "response"), (One("system", "system"), One("user", "prompt"), One("assistant", "response")), (_SYSTEM,)),
    Mapping("question", ("question", "answer"), (One("system", "system"), One("user", "question"), One("assistant", "answer")), (_SYSTEM,)),
    Mapping("prompt_messages", ("prompt[].role", "prompt[].content", "completion[].role", "completion[].content"), (Each("prompt", "role", "content"), Each("completion", "role", "content"))),
)


def lookup(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, str]:
    """Name of the mapping of every declared fingerprint; two mappings with a form in common are an error."""
    out: dict[str, str] = {}
    for m in mappings:
        for form in m.forms():
            key = hashlib.sha256("\n".join(form).encode()).hexdigest()
            if out.setdefault(key, m.name) != m.name:
                raise ValueError(f"{out[key]} and {m.name} have the same paths: {form}")
    return out


def canonical(records: DataFrame, json_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Adds paths, fingerprint, mapping and turns to records; the last two are null where no mapping declares the fingerprint."""
    known = sorted(set().union(*(m.tops() for m in mappings)))
    top = lambda p: F.regexp_extract(p, r"^((?:[^.\[{\\]|\\.)*)", 1)
    rows = records.withColumn("__cf_v", F.try_parse_json(records[json_col]))
    rows = rows.withColumn("paths", F.when(F.col("__cf_v").isNotNull(), F.filter(field_paths(F.col("__cf_v")), lambda p: top(p).isin(known))))
    rows = rows.withColumn("fingerprint", fingerprint(F.col("paths")))
    names = F.create_map(*(F.lit(x) for pair in lookup(mappings).items() for x in pair))
    rows = rows.withColumn("mapping", F.try_element_at(names, F.col("fingerprint")))
    turns = F.lit(None).cast(TURNS)
    for m in mappings:
        turns = F.when(F.col("mapping") == m.name, m.turns(F.col("__cf_v"))).otherwise(turns)
    return rows.withColumn("turns", turns).drop("__cf_v")


def unknown_layouts(found: DataFrame) -> DataFrame:
    """fingerprint, paths and number of the records of `canonical` that no mapping fits."""
    return found.where("mapping is null").groupBy("fingerprint", "paths").agg(F.count("*").alias("records"))


def in_layout(turns: Column, mapping: Mapping) -> Column:
    """Turns as a record of a layout whose steps are texts or arrays. The caller sees to it that they fit: with texts, one turn for each
    step (a system turn may be missing); with several arrays, the last turn alone is in the last one; roles are written by the mapping's names."""
    arrays = [s for s in mapping.steps if isinstance(s, Each)]
    fields: dict[str, Column] = {}
    if arrays:
        head = F.slice(turns, F.lit(1), F.size(turns) - (len(arrays) - 1))
        for s in arrays:
            fields |= s.written(head if s is arrays[0] else F.slice(turns, F.size(turns), F.lit(1)))
    else:
        texts = lambda role: F.get(F.filter(turns, lambda t: t["role"] == role), F.lit(0))["text"]
        for s in mapping.steps:
            fields[s.path if isinstance(s, One) else s.paths[0]] = texts(s.role)
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))


# ---- template


@dataclass(frozen=True)
class Template:
    """start role says text end, for each turn; foreign: control strings of other templates, which texts shall not hold either."""

    start: str = "<|start|>"
    says: str = "<|message|>"
    end: str = "<|end|>"
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
    learned: str = "assistant"

    def __post_init__(self):
        if any(len(c) < 2 or "\\" in c for c in self.controls):
            raise ValueError("a control string needs two characters and no backslash")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.start, self.says, self.end, *self.foreign)

    def escaped(self, text: Column) -> Column:
        broken = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), broken, r"$0\\")

    @staticmethod
    def unescaped(text: Column) -> Column:
        return F.regexp_replace(text, r"\\(\\?)", "$1")

    def formatted(self, turns: Column) -> tuple[Column, Column]:
        """The string, and the loss mask: for each assistant text its turn, where the turn begins, and the text's first and last (exclusive) code point."""
        parts = F.transform(turns, lambda t: F.struct((t["role"] == self.learned).alias("learned"), F.concat(F.lit(self.start), self.escaped(t["role"]), F.lit(self.says)).alias("head"), self.escaped(t["text"]).alias("body")))
        whole = F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], F.lit(self.end))), "")
        sizes = F.transform(parts, lambda p, i: F.struct(p["learned"].alias("learned"), i.alias("turn"), F.length(p["head"]).alias("head"), F.length(p["body"]).alias("body")))
        none = F.array().cast("array<struct<turn:int,at:int,first:int,last:int>>")

        def step(s: Column, p: Column) -> Column:
            first = s["at"] + p["head"]
            span = F.struct(p["turn"].alias("turn"), s["at"].alias("at"), first.alias("first"), (first + p["body"]).alias("last"))
            return F.struct((first + p["body"] + len(self.end)).alias("at"), F.when(p["learned"], F.concat(s["mask"], F.array(span))).otherwise(s["mask"]).alias("mask"))

        mask = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), none.alias("mask")), step, lambda s: s["mask"])
        return whole, mask

    def _pieces(self, whole: Column) -> Column:
        """The turns as they stand in the string, without their start."""
        return F.filter(F.split(whole, re.escape(self.start)), lambda p, i: i > 0)

    def turns(self, whole: Column) -> Column:
        """The turns, read back from the string."""

        def turn(p: Column) -> Column:
            at = F.locate(self.says, p)
            text = F.substring(p, at + len(self.says), F.length(p) - at - (len(self.says) + len(self.end)) + 1)
            return F.struct(self.unescaped(F.substring(p, F.lit(1), at - 1)).alias("role"), self.unescaped(text).alias("text"))

        return F.transform(self._pieces(whole), turn)

    def learned_text(self, whole: Column, mask: Column) -> Column:
        """All text under the mask, unescaped, read from the string."""
        pieces = self._pieces(whole)
        under = lambda m: self.unescaped(F.substring(F.get(pieces, m["turn"]), m["first"] - m["at"] - len(self.start) + 1, m["last"] - m["first"]))
        return F.array_join(F.transform(mask, under), "")


TEMPLATE = Template()


def chats(records: DataFrame, json_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS, template: Template = TEMPLATE) -> DataFrame:
    """`canonical` with formatted (string) and mask."""
    rows = canonical(records, json_col, mappings)
    whole, mask = template.formatted(F.col("turns"))
    return rows.withColumns({"formatted": whole, "mask": mask})


# ---- conversations


def conversation_turns(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and turns of a table with a row for each turn."""
    t = rows.select(rows[id_col].alias("conv_id"), F.struct(rows[turn_col].alias("turn"), F.coalesce(rows[role_col], F.lit("")).alias("role"), F.coalesce(rows[text_col], F.lit("")).alias("text")).alias("t"))
    held = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return held.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def mixed_records(conversations: DataFrame) -> DataFrame:
    """conv_id and record: each conversation in one of the layouts that can express it, by a hash of its id."""
    by = {m.name: m for m in MAPPINGS}
    roles = F.transform("turns", lambda t: t["role"])
    plain = F.forall(roles, lambda r: r.isin("system", "user", "assistant"))
    pair = F.array_join(roles, ",").isin("user,assistant", "system,user,assistant") & F.forall("turns", lambda t: t["text"] != "")
    pick = lambda n: F.pmod(F.xxhash64("conv_id"), F.lit(n))

    def one_of(*names: str) -> Column:
        out = in_layout(F.col("turns"), by[names[0]])
        for i, name in enumerate(names[1:], 1):
            out = F.when(pick(len(names)) == i, in_layout(F.col("turns"), by[name])).otherwise(out)
        return out

    record = F.when(pair, one_of("instruction", "completion", "response", "question", "messages", "conversations")).when(plain, one_of("messages", "conversations", "turns", "prompt_messages")).otherwise(one_of("messages", "turns"))
    return conversations.select("conv_id", record.alias("record"))


#: A conversation that holds control strings of a template.
ADDED = ((-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"))


def op11_schema_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.union(spark.createDataFrame(ADDED, rows.schema))
    out = chats(mixed_records(conversation_turns(rows)))
    whole = F.coalesce("formatted", F.raise_error(F.concat(F.lit("no layout for conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    out = out.select("conv_id", whole.alias("formatted"), "mask", "mapping")
    out = out.select("conv_id", "mapping", "formatted", TEMPLATE.turns(F.col("formatted")).alias("turns"), TEMPLATE.learned_text(F.col("formatted"), F.col("mask")).alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def _sql() -> str:
    quoted = lambda c: "'" + c.replace("'", "''") + "'"
    breaks = " + ".join(f"(length({{x}}) - length(replace({{x}}, {quoted(c)}, ''))) // {len(c)}" for c in TEMPLATE.controls)
    size = lambda x: f"length({x}) + length({x}) - length(replace({x}, '\\', '')) + " + breaks.replace("{x}", x)
    added = ", ".join(f"({c}, {t}, {quoted(r)}, {quoted(x)})" for c, t, r, x in ADDED)
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES {added})),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said, coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learned,
  sum({sum(len(x) for x in (TEMPLATE.start, TEMPLATE.says, TEMPLATE.end))} + {size("role")} + {size("text")})::BIGINT AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM g"""


QUERIES = {"op11_schema_fingerprint": op11_schema_fingerprint}
ORACLES = {"op11_schema_fingerprint": _sql()}
