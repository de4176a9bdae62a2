"""Scalar text, JSON and hash functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Marks deleted from names (fixed values).
NAME_MARKS = ".,!?:;\"'()[]{}"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_name(name: Column | str) -> Column:
    """Lower case, trimmed, white space collapsed, then the marks deleted; null gives the empty string."""
    flat = F.regexp_replace(F.trim(F.regexp_replace(F.lower(_c(name)), r"\s+", " ")), r"\s+", " ")
    return F.coalesce(F.translate(flat, NAME_MARKS, ""), F.lit(""))


def node_identifier(name: Column | str, chunk: Column | str, label: Column | str, schema_type: Column | str | None = None) -> Column:
    """`name (chunk id: X) [label]`, with the schema type before the bracket where there is one."""
    parts = [F.concat(F.lit("chunk id: "), _c(chunk))]
    if schema_type is not None:
        parts.append(F.concat(F.lit("schema_type: "), _c(schema_type)))
    return F.concat(_c(name), F.lit(" ("), F.concat_ws(", ", *parts), F.lit(") ["), _c(label), F.lit("]"))


def parse_identifier(s: Column | str) -> Column:
    """struct(name, chunk_id, schema_type, label, exact): exact tells whether the parts rebuild the string."""
    s = _c(s)
    some = lambda x: F.when(x != "", x)
    label = some(F.regexp_extract(s, r"\[([^\[\]]*)\]\s*$", 1))
    chunk = some(F.regexp_extract(s, r"\(chunk id: ([^,)]*)", 1))
    kind = some(F.regexp_extract(s, r"schema_type: ([^,)]*)", 1))
    name = F.trim(F.regexp_replace(F.regexp_replace(s, r"\s*\[[^\[\]]*\]\s*$", ""), r"\s*\((?:chunk id|schema_type): [^)]*\)\s*$", ""))
    inner = F.concat_ws(", ", F.concat(F.lit("chunk id: "), chunk), F.concat(F.lit("schema_type: "), kind))
    again = F.concat(name, F.when(inner != "", F.concat(F.lit(" ("), inner, F.lit(")"))).otherwise(""), F.lit(" ["), label, F.lit("]"))
    return F.struct(name.alias("name"), chunk.alias("chunk_id"), kind.alias("schema_type"), label.alias("label"), F.coalesce(again == s, F.lit(False)).alias("exact"))


def split_top_level(s: Column | str, most: int = 2) -> Column:
    """Splits at commas outside brackets, `most` times at most, parts trimmed. A comma counts as outside where
    as many brackets have closed as opened before it."""
    s = _c(s)
    chars = F.filter(F.split(s, ""), lambda x: x != "")
    zero = F.struct(F.lit(0).alias("depth"), F.array(F.lit("")).alias("parts"))

    def step(acc: Column, ch: Column) -> Column:
        depth = acc["depth"] + F.when(ch.isin("[", "(", "{"), 1).when(ch.isin("]", ")", "}"), -1).otherwise(0)
        cut = (ch == ",") & (acc["depth"] == 0) & (F.size(acc["parts"]) <= most)
        last = F.element_at(acc["parts"], -1)
        head = F.slice(acc["parts"], 1, F.size(acc["parts"]) - 1)
        parts = F.when(cut, F.concat(acc["parts"], F.array(F.lit("")))).otherwise(F.concat(head, F.array(F.concat(last, ch))))
        return F.struct(depth.alias("depth"), parts.alias("parts"))

    return F.transform(F.aggregate(chars, zero, step, lambda a: a["parts"]), lambda x: F.trim(x))


def parse_triple(s: Column | str) -> Column:
    """struct(head, relation, tail, score) of `(h, r, t)` or `(h, r, t) [score: x]`; null if it is neither."""
    s = F.trim(_c(s))
    body = F.regexp_extract(s, r"^\((.*)\)(?:\s*\[score: [-0-9.]+\])?$", 1)
    score = F.regexp_extract(s, r"\[score: ([-0-9.]+)\]$", 1)
    parts = split_top_level(body)
    return F.when((body != "") & (F.size(parts) == 3), F.struct(parts[0].alias("head"), parts[1].alias("relation"), parts[2].alias("tail"), F.expr("try_cast(null as double)").alias("none"), F.when(score != "", score.cast("double")).alias("score")))


def merged_values(values: Column | str) -> Column:
    """One value as it is, several as `[a, b]`."""
    v = _c(values)
    return F.when(F.size(v) == 1, v[0]).otherwise(F.concat(F.lit("["), F.concat_ws(", ", v), F.lit("]")))


def clean_llm_text(s: Column | str) -> Column:
    """Line ends to \\n, zero-width marks out, code fences and a leading `json` line unwrapped, trimmed."""
    s = F.regexp_replace(F.regexp_replace(_c(s), "\r\n?", "\n"), "[​‌‍﻿]", "")
    s = F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))
    fenced = F.regexp_extract(s, r"(?s)```[a-zA-Z]*\s*\n?(.*?)\n?```", 1)
    s = F.when(fenced != "", fenced).otherwise(s)
    return F.regexp_replace(F.regexp_replace(s, r"^json\s*\n", ""), r"^\s+|\s+$", "")


def tokens(text: Column | str, longer_than: int = 2) -> Column:
    """Distinct lower-cased words of more than `longer_than` characters, for the inverted index."""
    return F.array_distinct(F.filter(F.split(F.lower(_c(text)), r"\s+"), lambda x: F.char_length(x) > longer_than))


def keyword_score(text: Column | str, words: Column | str) -> Column:
    """How many of the distinct words are contained in the lower-cased text."""
    low = F.lower(_c(text))
    return F.size(F.filter(F.array_distinct(_c(words)), lambda w: low.contains(w)))


def question_words(q: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(_c(q))), r"\s+"), lambda x: x != ""))


#: Words that carry no meaning of their own in questions (fixed values).
STOP_WORDS = (
    "a about above after again all also am an and any are as at be because been before being below between both but by "
    "can could did do does doing down during each few for from further had has have having he her here hers him his how i if "
    "in into is it its itself just me more most my no nor not now of off on once only or other our ours out over own same she "
    "should so some such than that the their them then there these they this those through to too under until up very was we "
    "were what when where which while who whom why will with would you your yours"
).split()


def query_keywords(q: Column | str) -> Column:
    """Distinct lower-cased words of a question that are no stop words and longer than two characters.

    Parts of speech are approximated by the stop-word list, as no tagger is at hand.
    """
    words = F.transform(F.split(F.lower(_c(q)), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_except(F.filter(words, lambda w: F.char_length(w) > 2), stop)


def snippet(text: Column | str, n: int = 200, tail: str = "...") -> Column:
    t = _c(text)
    return F.when(F.char_length(t) > n, F.concat(F.substring(t, 1, n), F.lit(tail))).otherwise(t)


def dataset_name(s: Column | str) -> Column:
    """Letters, digits, space, - and _ alone, right-trimmed, spaces as _."""
    return F.translate(F.rtrim(F.regexp_replace(_c(s), r"[^\p{L}\p{N} _-]", "")), " ", "_")


def id_number(node_id: Column | str) -> Column:
    """The number after the first underscore of an id."""
    return F.expr("try_cast(null as bigint)") if node_id is None else F.split_part(_c(node_id), F.lit("_"), F.lit(2)).try_cast("bigint")


def final_answer(s: Column | str) -> Column:
    """What follows `So the answer is:`, or null."""
    x = F.regexp_extract(_c(s), r"(?is)so the answer is:\s*(.*)", 1)
    return F.when(x != "", F.trim(x))


def new_query(s: Column | str) -> Column:
    """The first line after `The new query is:`, or null."""
    x = F.regexp_extract(_c(s), r"(?i)the new query is:\s*([^\n]*)", 1)
    return F.when(F.trim(x) != "", F.trim(x))


#: Phrases of a rationale that speak for merging, and for keeping apart (fixed values).
MERGE_PHRASES = (
    "应该?合并", "可合并", "需要合并", "建议合并", "should.*merge", "can.*merge", "need.*merge", "identical", "equivalent", "same", "完全一致", "信息.*一致",
    "互换使用", "interchangeable", "同义", "synonym",
)
SEPARATE_PHRASES = (
    "应该?分开", "保持.*独立", "单独.*组", "不.*合并", "should.*separate", "keep.*separate", "distinct", "different", "不同", "有差异", "不一致",
)


def rationale_flag(rationale: Column | str, members: Column | str) -> Column:
    """True where a cluster of one speaks of merging and not of keeping apart."""
    low = F.lower(_c(rationale))
    merge, apart = "(?:" + "|".join(MERGE_PHRASES) + ")", "(?:" + "|".join(SEPARATE_PHRASES) + ")"
    return low.rlike(merge) & ~low.rlike(apart) & (F.size(_c(members)) == 1)


def rationale_numbers(rationale: Column | str) -> Column:
    """Numbers of the groups, clusters or members that a rationale names."""
    found = F.regexp_extract_all(F.lower(_c(rationale)), F.lit(r"(?:group|cluster|member|item|candidate|组|成员|项)s?\s*#?\s*(\d+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: x.cast("int")))


# JSON -----------------------------------------------------------------------------------------------

EXTRACTION = (
    "attributes map<string,array<string>>, triples array<array<string>>, entity_types map<string,string>, "
    "new_schema_types struct<nodes:array<string>,relations:array<string>,attributes:array<string>>"
)
CLUSTERS = "clusters array<struct<members:array<int>,description:string,rationale:string>>"
GROUPS = "groups array<struct<members:array<int>,representative:int,rationale:string>>"
COREFERENCE = "is_coreferent boolean, confidence double, representative string, preferred_representative string, rationale string"
DECOMPOSITION = "sub_questions array<struct<`sub-question`:string>>, involved_types struct<nodes:array<string>,relations:array<string>,attributes:array<string>>"
_TOLERANT = {"mode": "PERMISSIVE", "allowSingleQuotes": "true", "allowUnquotedFieldNames": "true", "allowNumericLeadingZeros": "true"}


def parsed(s: Column | str, schema: str) -> Column:
    """from_json of a cleaned model answer; what can't be read is null."""
    return F.from_json(F.regexp_replace(clean_llm_text(s), r",\s*([\]}])", "$1"), schema, _TOLERANT)


def member_groups(groups: Column, n: Column, offset: Column | int = 0) -> Column:
    """Groups of 1-based members as arrays of 0-based ones plus offset, those out of range dropped, each member
    in the first group that names it, and members that no group names on their own. No answer: all in one."""
    everyone = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    valid = F.transform(groups, lambda g: F.array_distinct(F.filter(F.transform(g["members"], lambda m: m - 1), lambda m: (m >= 0) & (m < n))))
    empty = F.array().cast("array<int>")
    start = F.struct(empty.alias("seen"), F.array().cast("array<array<int>>").alias("out"))
    taken = F.aggregate(
        valid,
        start,
        lambda acc, g: F.struct(
            F.array_union(acc["seen"], g).alias("seen"),
            F.when(F.size(F.array_except(g, acc["seen"])) > 0, F.concat(acc["out"], F.array(F.array_except(g, acc["seen"])))).otherwise(acc["out"]).alias("out"),
        ),
    )
    single = F.transform(F.array_except(everyone, taken["seen"]), lambda m: F.array(m))
    full = F.concat(taken["out"], single)
    return F.when(groups.isNull(), F.array(everyone)).otherwise(F.transform(full, lambda g: F.transform(g, lambda m: (m + offset).cast("int"))))


def representative(group: Column) -> Column:
    """A group's representative (1-based), or its first member if that is none of them."""
    return F.when(F.array_contains(group["members"], group["representative"]), group["representative"]).otherwise(group["members"][0])


def coreference(s: Column | str, require_representative: bool = True) -> Column:
    """struct(is_coreferent, confidence, representative, rationale); unreadable answers and agreement without a
    representative (if required) count as no."""
    j = parsed(s, COREFERENCE)
    rep = F.coalesce(j["representative"], j["preferred_representative"])
    yes = F.coalesce(j["is_coreferent"], F.lit(False))
    if require_representative:
        yes = yes & rep.isNotNull() & (rep != "")
    return F.struct(yes.alias("is_coreferent"), F.coalesce(j["confidence"], F.lit(0.0)).alias("confidence"), F.when(yes, rep).alias("representative"), F.coalesce(j["rationale"], F.lit("")).alias("rationale"))


def decomposition(s: Column | str) -> Column:
    """struct(sub_questions array<string>, nodes, relations, attributes) from an object or a bare list."""
    obj = parsed(s, DECOMPOSITION)
    bare = F.from_json(clean_llm_text(s), "array<struct<`sub-question`:string>>", _TOLERANT)
    subs = F.coalesce(obj["sub_questions"], bare)
    none = F.array().cast("array<string>")
    kind = lambda k: F.coalesce(obj["involved_types"][k], none).alias(k)
    return F.struct(F.transform(subs, lambda x: x["sub-question"]).alias("sub_questions"), kind("nodes"), kind("relations"), kind("attributes"))


def canonical_json(props: Column | str) -> Column:
    """JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(_c(props)))))


def cache_key(parts: Column | str) -> Column:
    """The first 16 hex digits of the SHA-256 of an array's sorted entries."""
    return F.substring(F.sha2(F.concat_ws(",", F.array_sort(_c(parts))), 256), 1, 16)


def prompt_hash(prompt: Column | str) -> Column:
    return F.sha2(F.coalesce(_c(prompt), F.lit("")), 256)


# validation of dedup interchange ----------------------------------------------------------------------

INTERCHANGE = (
    "head_node struct<label:string,properties:map<string,string>>, relation string, tail_nodes_to_dedup array<string>, "
    "dedup_results map<string,struct<member:array<string>,llm_judge_reason:string>>, deduped_tails array<string>"
)


def member_issues(member: Column | str) -> Column:
    """What is wrong with the string of a member: errors first, then warnings."""
    m = _c(member)
    return F.array_compact(
        F.array(
            F.when(~m.rlike(r"\[[^\[\]]+\]\s*$"), F.lit("error: no label")),
            F.when(F.trim(F.regexp_replace(m, r"\s*(\(.*\))?\s*(\[[^\[\]]*\])?\s*$", "")) == "", F.lit("error: empty name")),
            F.when(~m.contains("(chunk id:"), F.lit("warning: no chunk id")),
        )
    )


def group_issues(head: Column, relation: Column, results: Column) -> Column:
    """What is wrong with a group of the interchange: its node, its relation and its clusters."""
    sizes = F.transform(F.map_values(results), lambda c: F.coalesce(F.size(c["member"]), F.lit(0)))
    return F.array_compact(
        F.array(
            F.when(head.isNull(), F.lit("error: no head_node")),
            F.when(head.isNotNull() & F.coalesce(head["label"], F.lit("")).eqNullSafe(""), F.lit("error: no label")),
            F.when(head.isNotNull() & F.coalesce(head["properties"]["name"], F.lit("")).eqNullSafe(""), F.lit("error: no name")),
            F.when(F.coalesce(relation, F.lit("")) == "", F.lit("error: no relation")),
            F.when(results.isNull(), F.lit("error: no dedup_results")),
            F.when(F.size(results) == 0, F.lit("warning: no clusters")),
            F.when(F.exists(sizes, lambda n: n == 0), F.lit("warning: empty cluster")),
            F.when(F.exists(sizes, lambda n: n == 1), F.lit("warning: cluster of one")),
        )
    )


def register(spark: SparkSession) -> None:
    """Makes the vector and text functions callable from SQL as temporary SQL functions."""
    for ddl in (
        "dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
        "l2_normalize(a ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> RETURN transform(a, x -> x / nullif(sqrt(aggregate(a, 0D, (s, y) -> s + y * y)), 0D))",
        "cosine_sim(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D)",
        "normalize_entity_name(s STRING) RETURNS STRING RETURN coalesce(translate(trim(regexp_replace(lower(s), '\\\\s+', ' ')), '.,!?:;\"\\'()[]{}', ''), '')",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {ddl}")


def enhanced_query(q: Column | str, most: int = 5) -> Column:
    """The question with up to `most` of its key terms appended."""
    terms = F.slice(query_keywords(q), 1, most)
    return F.when(F.size(terms) > 0, F.concat(_c(q), F.lit(" Key terms: "), F.concat_ws(", ", terms))).otherwise(_c(q))
