"""Prompts from templates and the label tree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import placeholders
from ..sources.vocabulary import Vocabulary

SCHEMA = "prompt_idx int, category string, tpl_no int, prompt string, prompt_cn string, prompt_en string, label_cn string, label_en string, labels map<string,string>, cat_cn map<string,string>, cat_en map<string,string>"


def category_labels(labels: DataFrame) -> DataFrame:
    """Labels of a category over its subcategories: category, label_cn, label_en, ord. A label that two subcategories have
    stays in the first place, with the last translation."""
    return labels.groupBy("category", "label_cn").agg(F.max_by("label_en", "ord").alias("label_en"), F.min("ord").alias("ord"))


def resolve(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """For each placeholder the entry of ``index`` (name, ord, parent) of that name, else the first whose name holds it.

    The index has a row for each subcategory and category, so it is small by its nature; the substring test is a
    nested-loop join against it."""
    pairs = wanted.join(F.broadcast(index), index.name.contains(wanted.placeholder), "left")
    w = Window.partitionBy("placeholder").orderBy((F.col("name") == F.col("placeholder")).desc_nulls_last(), F.col("ord").asc_nulls_last())
    return pairs.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("placeholder", "name", "parent")


def placeholder_index(vocabulary: Vocabulary) -> dict[str, tuple[str, dict[str, str]]]:
    """name -> (parent category, labels): all subcategories in order, then categories whose names none of them has."""
    index: dict[str, tuple[str, dict[str, str]]] = {}
    whole: dict[str, dict[str, str]] = {}
    for category, sub, cn, en, _ in vocabulary.labels:
        index.setdefault(sub, (category, {}))[1][cn] = en
        whole.setdefault(category, {})[cn] = en
    for category, entries in whole.items():
        index.setdefault(category, (category, entries))
    return index


def prompt_table(spark: SparkSession, vocabulary: Vocabulary, language: str = "en") -> DataFrame:
    """All prompts (SCHEMA): each template with every combination of labels for its placeholders, the last one fastest.

    A placeholder that is no name takes the first name that holds it; templates with one that nothing holds are left
    out. label_cn and label_en are set for templates of one placeholder; cat_cn and cat_en hold the labels whose parent is
    the template's category. The combinations are joins, so a large product is made on the executors."""
    index = placeholder_index(vocabulary)
    known = {category: i for i, category in enumerate(vocabulary.categories)}
    parts, before = [], 0
    for category, number, zh, en in sorted(vocabulary.templates, key=lambda t: (known.get(t[0], len(known)), t[1])):
        names = list(dict.fromkeys(placeholders(zh)))
        found = {p: p if p in index else next((k for k in index if p in k), None) for p in names}
        if not names or None in found.values():
            continue
        sizes = [len(index[found[p]][1]) for p in names]
        rows = None
        for i, p in enumerate(names):
            entries = [(j, cn, en_) for j, (cn, en_) in enumerate(index[found[p]][1].items())]
            side = spark.createDataFrame(entries, f"o{i} int, cn{i} string, en{i} string")
            rows = side if rows is None else rows.crossJoin(side)
        place = reduce(lambda acc, i: acc * sizes[i] + F.col(f"o{i}"), range(len(names)), F.lit(0))
        texts = {}
        for key, template, kind in (("prompt_cn", zh, "cn"), ("prompt_en", en, "en")):
            texts[key] = reduce(lambda acc, i: F.replace(acc, F.lit("{" + names[i] + "}"), F.col(f"{kind}{i}")), range(len(names)), F.lit(template))
        own = [i for i, p in enumerate(names) if index[found[p]][0] == category]
        single = len(names) == 1

        def as_map(kind: str, which: list[int]) -> F.Column:
            # two placeholders of one parent: the later one counts
            return F.create_map(F.lit(category), F.col(f"{kind}{which[-1]}")) if which else F.expr("cast(map() as map<string,string>)")

        parts.append(
            rows.select(
                (place + before).cast("int").alias("prompt_idx"), F.lit(category).alias("category"), F.lit(number).alias("tpl_no"),
                texts["prompt_en" if language == "en" else "prompt_cn"].alias("prompt"), texts["prompt_cn"].alias("prompt_cn"), texts["prompt_en"].alias("prompt_en"),
                (F.col("cn0") if single else F.lit(None).cast("string")).alias("label_cn"), (F.col("en0") if single else F.lit(None).cast("string")).alias("label_en"),
                F.create_map(*[x for i, p in enumerate(names) for x in (F.lit(p), F.col(f"cn{i}"))]).alias("labels"), as_map("cn", own).alias("cat_cn"), as_map("en", own).alias("cat_en"),
            )
        )
        before += reduce(lambda a, b: a * b, sizes)
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SCHEMA)


def prompt_counts(prompts: DataFrame) -> DataFrame:
    return prompts.groupBy("category").agg(F.count("*").alias("n_prompts"))


def consistency(required: DataFrame, tree: DataFrame, templates: DataFrame) -> DataFrame:
    """problem, category: required categories that the tree lacks, those of the tree without a template, and templates
    without a category. Each input has a column ``category``."""
    r, c, t = (x.select("category").distinct() for x in (required, tree, templates))
    parts = {"not_in_tree": r.exceptAll(c), "without_template": r.intersect(c).exceptAll(t), "without_category": t.exceptAll(c)}
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("problem"), "category") for name, df in parts.items()])


def verification_text(labels: dict[str, F.Column], texts: dict[str, str], instruction: str, answer: str = '"yes/no"', form: str = "Format: ") -> F.Column:
    """The question for a scene: the instruction, a line for each label by its category's text, and the form of the answer.
    Categories without a label have no line; those without a text of their own have ``- category: label``."""
    asked = {c: F.when(F.coalesce(v, F.lit("")) != "", v) for c, v in labels.items()}
    lines = [F.replace(F.replace(F.lit(texts.get(c, "- {cat}: {val}")), F.lit("{cat}"), F.lit(c)), F.lit("{val}"), v) for c, v in asked.items()]
    pairs = F.concat_ws(", ", *[F.when(v.isNotNull(), f'"{c}": {answer}') for c, v in asked.items()])
    return F.concat_ws("\n", F.lit(instruction), *lines, F.concat(F.lit(form + "{"), pairs, F.lit("}")))
