"""Results as CSV and JSON files: nested columns flattened, headers united, values written as the formats define."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the translation table.
TRANSLATION_COLUMNS = (
    "id model_name language_pair composite_score bleu_1 bleu_2 bleu_4 rouge_1_f1 rouge_2_f1 rouge_l_f1 chrf wer cer tfidf_cosine jaccard"
    " length_ratio length_score content_word_overlap bigram_overlap sentence_overlap lex_div_original lex_div_backtranslation"
    " orig_word_count bt_word_count llm_overall_score llm_translation_accuracy llm_fluency llm_meaning_preservation llm_naturalness"
    " llm_grammatical_correctness"
).split()
# Dimensions of a judge's verdict on a translation.
JUDGED = ("translation_accuracy", "fluency", "meaning_preservation", "naturalness", "grammatical_correctness")


def flatten(df: DataFrame, joint: str = "_") -> DataFrame:
    """Struct columns as columns of their fields, named <column><joint><field>, at every depth; other columns as they are."""

    def fields(kind: T.StructType, path: list[str]) -> list[Column]:
        out = []
        for f in kind.fields:
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                out += fields(f.dataType, here)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(joint.join(here)))
        return out

    return df.select(*fields(df.schema, []))


def scalars(df: DataFrame) -> DataFrame:
    """Without the columns that hold lists or maps."""
    return df.select(*[f"`{f.name}`" for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType))])


def united(*tables: DataFrame) -> DataFrame:
    """All rows under the union of the headers, in the order in which columns first come; missing values are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def listed(df: DataFrame) -> DataFrame:
    """Lists and maps as JSON text, so that a CSV file can hold them."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields])


def blank_zeros(df: DataFrame) -> DataFrame:
    """Numbers and flags as text, with zero, false and null all empty: the summary table's form."""

    def text(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            return F.when(c, "True").alias(f.name)
        if isinstance(f.dataType, T.NumericType):
            return F.when(c != 0, c.cast("string")).alias(f.name)
        return c.alias(f.name)

    return df.select(*[text(f) for f in df.schema.fields])


def non_finite_as_text(df: DataFrame) -> DataFrame:
    """Doubles that are no finite number as text columns (inf, -inf, nan), where a column holds one type only."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    spelled = lambda c: F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(c.cast("string"))
    return df.withColumns({n: spelled(F.col(n)) for n in doubles})


def translation_table(df: DataFrame, verdict: str | None = None) -> DataFrame:
    """The translation measures under their fixed header; verdict: a struct column of a judge's scores."""
    if verdict:
        df = df.withColumns({"llm_overall_score": F.col(f"{verdict}.overall_score"), **{f"llm_{d}": F.col(f"{verdict}.{d}.score") for d in JUDGED}})
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in TRANSLATION_COLUMNS])


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; values with commas, quotation marks or line breaks are quoted, inner quotation marks doubled."""
    df.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def summary_judge_prompt(prompt: str = "prompt", source: str = "source", summary: str = "summary", url: str = "url", most: int = 3000) -> Column:
    """Text that asks a judge for scores of a summary, the source cut to `most` characters."""
    cut = F.concat(F.substring(F.col(source), 1, most), F.when(F.length(source) > most, "...").otherwise(""))
    given = F.when(F.length(F.coalesce(F.col(source), F.lit(""))) > 0, F.concat(F.lit("\n## Source Text\n"), cut, F.lit("\n"))).when(F.length(F.coalesce(F.col(url), F.lit(""))) > 0, F.concat(F.lit("\n## Source URL\n"), F.col(url), F.lit("\n"))).otherwise("")
    wanted = ", ".join(f'"{d}":{{"score":N,"justification":"..."}}' for d in ("factual_accuracy", "completeness", "conciseness", "coherence_fluency", "prompt_faithfulness", "overall"))
    return F.concat(F.lit("Score this summary from 0 to 10 on each dimension, with a short justification.\n\n## Prompt Given\n"), F.coalesce(prompt, F.lit("")), given, F.lit("\n## Summary\n"), F.coalesce(summary, F.lit("")), F.lit(f"\n\nRespond with this JSON alone:\n{{{wanted}}}"))


def translation_judge_prompt(original: str = "original", translation: str = "translation", back: str = "back_translation", pair: str = "language_pair", model: str = "model_name", most: int = 2500) -> Column:
    """Text that asks a judge for scores of a translation, each text cut to `most` characters."""
    part = lambda title, c: F.concat(F.lit(f"\n{title}:\n"), F.substring(F.coalesce(F.col(c), F.lit("")), 1, most), F.lit("\n"))
    wanted = ", ".join(f'"{d}":{{"score":0,"justification":""}}' for d in JUDGED) + ', "overall_score":0, "overall_assessment":""'
    head = F.concat(F.lit("Score this translation from 0 to 10 on each dimension.\nModel: "), F.coalesce(model, F.lit("Unknown")), F.lit("\nLanguage pair: "), F.coalesce(pair, F.lit("Unknown")), F.lit("\n"))
    return F.concat(head, part("Original (A)", original), part("Translation (B)", translation), part("Back-translation (C)", back), F.lit(f"\nRespond with this JSON alone:\n{{{wanted}}}"))
