"""Raw datasets to the five-field record: data_source, prompt, ability, reward_model, extra_info."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions.graders import boxed
from quillstream.functions.messages import rewrite_user, strip_constraints


def messages(*pairs: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in pairs])


def record(source: Column | str, prompt: Column, ability: str, truth: Column, style: str = "rule", extra: Column | None = None) -> list[Column]:
    source = F.lit(source) if isinstance(source, str) else source
    return [
        source.alias("data_source"), prompt.alias("prompt"), F.lit(ability).alias("ability"),
        F.struct(F.lit(style).alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        (extra if extra is not None else F.struct(F.lit(0).cast("long").alias("index"))).alias("extra_info")
    ]


def grade_school_math(
    df: DataFrame, instruction: str = 'Let\'s think step by step and output the final answer after "####".', split: str = "train"
) -> DataFrame:
    """question, answer, row_id: the number after the hashes, without commas."""
    truth = F.regexp_replace(F.regexp_extract("answer", r"#### (-?[0-9.,]+)", 1), ",", "")
    extra = F.struct(
        F.lit(split).alias("split"), F.col("row_id").cast("long").alias("index"), F.col("answer").alias("answer"), F.col("question").alias("question")
    )
    return df.select(*record("grade_school_math", messages(("user", F.concat("question", F.lit(" " + instruction)))), "math", truth, extra=extra))


def competition_math(df: DataFrame, instruction: str = "Let's think step by step and output the final answer within \\boxed{}.") -> DataFrame:
    """problem, solution, row_id: the content of the last box."""
    return df.select(
        *record(
            "competition_math", messages(("user", F.concat("problem", F.lit(" " + instruction)))), "math", boxed(F.col("solution")),
            extra=F.struct(F.col("row_id").cast("long").alias("index"))
        )
    )


def sentence_completion(df: DataFrame) -> DataFrame:
    """activity_label, ctx, endings, label: unlabelled rows go, bracketed artefacts too."""
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.replace(x, F.lit(" [title]"), F.lit(". ")), r"\[.*?\]", ""), "  ", " "))
    rows = df.where(F.length("label") > 0)
    prompt = clean(F.concat("activity_label", F.lit(": "), "ctx"))
    model = F.struct(
        F.lit("model").alias("style"), F.lit("multiple_choice").alias("eval"), F.col("label").cast("int").alias("ground_truth"),
        F.transform("endings", clean).alias("choices")
    )
    return rows.select(
        F.lit("sentence_completion").alias("data_source"), messages(("user", prompt)).alias("prompt"), F.lit("nlp").alias("ability"),
        model.alias("reward_model")
    )


def preferences_to_sft(df: DataFrame) -> DataFrame:
    """Each pair gives two rows: prompt with the chosen and with the rejected answer."""
    return df.select("prompt", F.explode(F.array("chosen", "rejected")).alias("response"))


def preference_split(df: DataFrame, share: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """The first share of the rows by row_id, and the rest."""
    from quillstream.operators.frame import with_position

    n = int(df.count() * share)
    at = with_position(df)
    return at.where(F.col("rn") < n).drop("rn"), at.where(F.col("rn") >= n).drop("rn")


def search_questions(df: DataFrame, prefix: str) -> DataFrame:
    """question, golden_answers and maybe reward_model.ground_truth: the truth is the first there is."""
    truth = F.coalesce("reward_model.ground_truth", "golden_answers") if "reward_model" in df.columns else F.col("golden_answers")
    kwargs = F.create_map(F.lit("question"), F.col("question"), F.lit("data_source"), F.col("data_source"))
    extra = F.struct(
        F.col("row_id").cast("long").alias("index"), F.lit(True).alias("need_tools_kwargs"), F.col("question").alias("question"),
        kwargs.alias("tools_kwargs")
    )
    return df.select(
        *record(
            F.concat(F.lit("search_"), "data_source"), messages(("user", F.concat(F.lit(prefix), "question"))), "fact-reasoning", truth, extra=extra
        )
    )


def constrained_instructions(df: DataFrame) -> DataFrame:
    """messages, ground_truth, constraint, constraint_type, key, row_id: the prompt as given, and
    one without its constraints for perplexities."""
    extra = F.struct(F.col("row_id").cast("long").alias("index"), "key", "constraint", "constraint_type")
    bare = rewrite_user(F.col("messages"), lambda c: strip_constraints(c, F.col("constraint")))
    return df.select(
        *record("constrained_instructions", F.col("messages"), "instruction_following", F.col("ground_truth"), extra=extra), bare.alias("ppl_prompt")
    )


def preferences_to_rl(df: DataFrame, split: str = "train") -> DataFrame:
    """prompt, response, row_id: the answer is kept as truth, though a model scores."""
    extra = F.struct(F.lit(split).alias("split"), F.col("row_id").cast("long").alias("index"))
    return df.select(*record("preferences", messages(("user", F.col("prompt"))), "alignment", F.col("response"), "model", extra))


def grade_school_turns(df: DataFrame, system: str, tool: str | None = None, agent: str | None = None, split: str = "train") -> DataFrame:
    """Grade-school mathematics as a chat with a system message, and, for a tool or an agent, with
    what they need beside the record."""
    truth = F.regexp_replace(F.regexp_extract("answer", r"#### (-?[0-9.,]+)", 1), ",", "")
    extra = [F.lit(split).alias("split"), F.col("row_id").cast("long").alias("index")]
    if tool:
        kwargs = F.create_map(F.lit(tool), F.struct(truth.alias("ground_truth")))
        extra += [F.lit(True).alias("need_tools_kwargs"), kwargs.alias("tools_kwargs")]
    out = record("grade_school_math", messages(("system", F.lit(system)), ("user", F.col("question"))), "math", truth, extra=F.struct(*extra))
    return df.select(*out, *([F.lit(agent).alias("agent_name")] if agent else []))


def grade_school_sft(df: DataFrame, system: str) -> DataFrame:
    """The chat with its solution: messages."""
    return df.select(messages(("system", F.lit(system)), ("user", F.col("question")), ("assistant", F.col("answer"))).alias("messages"))


def write_split(df: DataFrame, out: str, key: str, val_size: int, seed: int = 1) -> None:
    """train.parquet and val.parquet of a seeded split."""
    from quillstream.sources.scans import train_val_split

    train, val = train_val_split(df, key, val_size, seed)
    train.write.mode("overwrite").parquet(f"{out}/train.parquet")
    val.write.mode("overwrite").parquet(f"{out}/val.parquet")
