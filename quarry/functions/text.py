"""Scalar functions of prompts and messages, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ordered keyword rules of the three taxonomies; a keyword is a substring of the lower-cased text.
EIGHT = {
    "math/calculator": ["calculator", "math", "compute"], "weather": ["weather", "temperature"], "communication": ["email", "message"], "search": ["search", "query"],
    "finance": ["finance", "currency", "exchange"], "calendar": ["calendar", "schedule"], "database": ["database", "sql"],
}
THREE = {"finance": ["finance", "currency", "exchange"], "communication": ["email", "message"]}
SIX = {
    "Finance": ["tax", "tip", "loan", "currency", "discount", "invoice", "shipping", "finance", "budget", "investment", "interest"],
    "Math": ["average", "sum", "math", "calculator", "area", "volume", "geometry", "random", "number"],
    "Personal": ["age", "bmi", "date", "time", "personal", "alarm", "schedule"],
    "Search": ["search", "weather", "news", "find", "locate"],
    "Travel": ["flight", "hotel", "travel", "booking", "trip"],
}
GENERAL = "general"  # what the three-way taxonomy calls the rest in domain heatmaps
ROLES = {"USER": "user", "ASSISTANT": "assistant", "FUNCTION RESPONSE": "tool"}


TOOL_ROLES = ("tool", "function", "function response")


def domain(text: Column | str, rules: dict[str, list[str]], other: str = "other") -> Column:
    """The first rule of which a keyword is in the text."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    out = None
    for name, keys in rules.items():
        hit = low.contains(keys[0])
        for k in keys[1:]:
            hit = hit | low.contains(k)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def domain_match(text: Column | str, keywords: list[str], on: bool = False) -> Column:
    """Whether a text has one of the keywords; always true unless ``on``, as data preparation leaves the filter off."""
    low, hit = F.lower(F.col(text) if isinstance(text, str) else text), F.lit(False)
    for k in keywords:
        hit = hit | low.contains(k)
    return hit if on else F.lit(True)


def is_tool_call(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return c.contains("{") & c.contains("}")


def squeeze(text: Column | str) -> Column:
    """Without any white space, of Unicode too."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def exact_label(truth: str, generated: str) -> Column:
    return F.when(squeeze(truth) == squeeze(generated), 0).otherwise(1)


def value_key(v: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(v), " ", ""))


def chat_turns(text: Column | str, end: str = "<|endoftext|>") -> Column:
    """USER: / ASSISTANT: / FUNCTION RESPONSE: text as an array of (role, content)."""
    marked = F.regexp_replace(text, r"(?:^|\n)(USER|ASSISTANT|FUNCTION RESPONSE):", "\u0001$1\u0002")
    parts = F.filter(F.split(marked, "\u0001"), lambda p: p.contains("\u0002"))
    roles = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.transform(parts, lambda p: F.struct(F.element_at(roles, F.split_part(p, F.lit("\u0002"), F.lit(1))).alias("role"), F.trim(F.replace(F.split_part(p, F.lit("\u0002"), F.lit(2)), F.lit(end), F.lit(""))).alias("content")))


def merge_turns(messages: Column | str) -> Column:
    """Tool turns become the user's; neighbours of one role join with a blank line."""
    roled = F.transform(messages, lambda m: F.struct(F.when(m["role"].isin(*TOOL_ROLES), "user").otherwise(m["role"]).alias("role"), m["content"].alias("content")))

    def add(acc, m):
        last = F.element_at(acc, -1)
        joined = F.struct(last["role"].alias("role"), F.concat_ws("\n\n", last["content"], m["content"]).alias("content"))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["role"] == m["role"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(m)))

    empty = F.array().cast("array<struct<role:string,content:string>>")
    return F.aggregate(roled, empty, lambda acc, m: F.when(F.size(acc) == 0, F.array(m)).otherwise(add(acc, m)))


def merge_turn_rows(df: DataFrame, conv: str, turn: str, role: Column, text: str) -> DataFrame:
    """The same for one message a row: runs of one role as islands of a window, joined in order of turn."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(conv).orderBy(turn)
    new = (F.lag("role").over(w).isNull() | (F.lag("role").over(w) != F.col("role"))).cast("int")
    runs = df.withColumn("role", role).withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(turn, text))), lambda x: x[text]), "\n\n")
    return runs.groupBy(conv, "run", "role").agg(joined.alias("content"), F.count("*").alias("turns"))


def target_turn(messages: Column | str, tool_only: bool = False) -> Column:
    """The last assistant turn, with braces if ``tool_only``."""
    ok = lambda m: (m["role"] == "assistant") & (is_tool_call(m["content"]) if tool_only else F.lit(True))
    return F.try_element_at(F.filter(messages, ok), F.lit(-1))


def last_user(messages: Column | str) -> Column:
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(-1))


def zero_shot(messages: Column | str, system: Column) -> Column:
    """The system message, if any, and the last user turn."""
    head = F.when(F.length(system) > 0, F.array(F.struct(F.lit("system").alias("role"), system.alias("content")))).otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    return F.concat(head, F.array(last_user(messages)))


def template(messages: Column | str) -> Column:
    return F.concat(F.array_join(F.transform(messages, lambda m: F.concat(F.upper(m["role"]), F.lit(": "), m["content"])), "\n"), F.lit("\nASSISTANT:"))


def tool_names(prompt: Column | str) -> Column:
    return F.regexp_extract_all(prompt, F.lit(r'"name"\s*:\s*"([^"]+)"'), F.lit(1))


def list_literal(text: Column | str) -> Column:
    """A list of names written as a Python literal, read as JSON and never evaluated."""
    return F.from_json(F.translate(text, "'", '"'), "array<string>")


def ellipsis(text: Column | str, most: int = 40) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def first_turns(messages: Column | str) -> Column:
    """The last system message, the first user turn and the first assistant turn after it, as a struct of texts."""
    m = F.col(messages) if isinstance(messages, str) else messages
    of = lambda x, role: F.filter(x, lambda t: t["role"] == role)
    at = F.array_position(F.transform(m, lambda t: t["role"]), "user")
    after = F.when(at > 0, F.slice(m, F.greatest(at, F.lit(1)).cast("int"), F.greatest(F.size(m), F.lit(1))))
    return F.struct(F.try_element_at(of(m, "system"), F.lit(-1))["content"].alias("system"), F.try_element_at(of(m, "user"), F.lit(1))["content"].alias("user"), F.try_element_at(of(after, "assistant"), F.lit(1))["content"].alias("assistant"))


def short_label(feature: Column | str) -> Column:
    """L22 of L22_HFER: short, and the same for two metrics of a layer."""
    return F.split_part(F.col(feature) if isinstance(feature, str) else feature, F.lit("_"), F.lit(1))


def full_label(features: Column | str) -> Column:
    return F.array_join(features, ", ")


def safe_filename(name: Column | str) -> Column:
    """Letters, digits, blanks as underscores; other punctuation goes."""
    return F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9 _-]", ""), " ", "_")


def display_name(model: Column | str) -> Column:
    return F.regexp_replace(model, "-8B|-7B", "")
