"""From raw benchmark records to training records: normalisation, validation, prompts, length filter and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sqltext as tx

C = F.col
#: Names a field may have, the first that isn't empty counts.
ALIASES = {"gold_sql": ("gold_sql", "query", "SQL", "sql"), "db_id": ("db_id", "database", "database_name"), "evidence": ("evidence", "external_knowledge", "hint"), "question": ("question",)}
#: Tags in which a prompt's user message holds a field.
TAGS = {"db_id": "db_id", "evidence": "hint", "question": "question"}


def truthy(*columns: Column) -> Column:
    """The first of the columns that is neither null nor empty, else an empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def normalised(df: DataFrame) -> DataFrame:
    """df with gold_sql, db_id, evidence and question from whichever alias holds them, else from the tags of its user message; nulls become empty texts.

    messages, where there, is an array of (role, content); assistant messages are left out of prompt.
    """
    have = {c.lower(): c for c in df.columns}
    out = df
    user = tx.first_of_role("messages", "user") if "messages" in df.columns else None
    fields = {}
    for field, names in ALIASES.items():
        sources = [C(f"`{have[n.lower()]}`") for n in dict.fromkeys(n.lower() for n in names) if n in have]
        if user is not None and field in TAGS:
            sources.append(tx.tag_value(user, TAGS[field]))
        if user is not None and field == "question":
            sources.append(tx.question_text(user))
        fields[field] = truthy(*sources)
    out = df.select(*[C(f"`{c}`") for c in df.columns if c not in fields], *[v.alias(k) for k, v in fields.items()])
    return out.withColumn("prompt", tx.without_role("messages")) if "messages" in df.columns else out


def incomplete(df: DataFrame, required: list[str]) -> DataFrame:
    """Rows in which a required field is null or empty."""
    test = F.lit(False)
    for c in required:
        test = test | (F.coalesce(C(c), F.lit("")) == "")
    return df.where(test)


def validate(df: DataFrame, required: list[str], key: str) -> DataFrame:
    """df, if every required field is filled; else an error that names the first five offenders."""
    bad = incomplete(df, required).select(key).orderBy(key).limit(5).collect()
    if bad:
        raise ValueError(f"{', '.join(required)} missing in {key} {', '.join(str(r[0]) for r in bad)}")
    return df


def few_shot_text(examples: Column) -> Column:
    """An array of (db_id, question, evidence, SQL) as numbered examples; '(no examples)' for none."""
    line = lambda e, i: F.concat(
        F.format_string("- Example %d (db: %s)\n  Q: %s\n", (i + 1).cast("int"), F.coalesce(e["db_id"], F.lit("?")), F.coalesce(e["question"], F.lit(""))),
        F.when(F.coalesce(e["evidence"], F.lit("")) != "", F.concat(F.lit("  Hint: "), e["evidence"], F.lit("\n"))).otherwise(F.lit("")),
        F.coalesce(e["SQL"], F.lit("")),
    )
    return F.when(F.coalesce(F.size(examples), F.lit(0)) <= 0, F.lit("(no examples)")).otherwise(F.array_join(F.transform(examples, line), "\n"))


def user_prompt(question: Column, hint: Column, db_id: Column, schema: Column | None = None, examples: Column | None = None) -> Column:
    """The user message of a training record."""
    q, h, d = (F.coalesce(x, F.lit("")) for x in (question, hint, db_id))
    part = lambda tag, x: F.concat(F.lit(f"<{tag}>\n"), x, F.lit(f"\n</{tag}>\n\n"))
    text = [F.lit("\n")]
    if examples is not None:
        text += [few_shot_text(examples), F.lit("\n\n")]
    text += [part("question", q), part("hint", h)]
    if schema is not None:
        text.append(part("database_schema", schema))
    return F.concat(*text, F.lit("<db_id>"), d, F.lit("</db_id>\n\n---\nQuestion: "), q, F.lit("\nEvidence: "), h, F.lit("\n"))


def gold_turn(sql: Column) -> Column:
    """The assistant's message that holds the reference statement."""
    return F.concat(F.lit("<scratch_pad>\nGold reference SQL.\n</scratch_pad>\n<final_answer>\n<sql_code>"), F.coalesce(sql, F.lit("")), F.lit("</sql_code>\n</final_answer>"))


def by_length(df: DataFrame, tokens: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): rows of at most most tokens, and the others."""
    return df.where(F.coalesce(tokens, F.lit(0)) <= most), df.where(F.coalesce(tokens, F.lit(0)) > most)


def is_cut_off(tokens: Column, most: int, ends: list[int]) -> Column:
    """Whether an array of ids reached most ids without one of ends at its end."""
    return (F.size(tokens) >= most) & ~F.coalesce(F.array_contains(F.array(*map(F.lit, ends)), F.try_element_at(tokens, F.lit(-1))), F.lit(False))


def padded(tokens: Column, width: int, pad: int) -> Column:
    """An array brought to width with pad."""
    return F.concat(tokens, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), width - F.size(tokens))))


def sample_rows(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """size rows without replacement, the same for any partitioning; all rows if size is 0, less, or reaches them. A top-k, no sort of all rows."""
    return df if size <= 0 else df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), C(key).cast("string"))), key).limit(size)
