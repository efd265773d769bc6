"""The label vocabulary: a JSON tree of categories, subcategories and labels, with templates and settings."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Keys of the vocabulary file.
LABELS, TEMPLATES, SETTINGS = "标签", "自动提纯prompt", "其他参数设置"
NAME_FORMAT, REQUIRED, REQUIRED_SUB, REQUIRED_LABELS, VERIFY = "输出视频命名格式", "必有标签", "必有子类", "必有孙类", "MiniCPM验证Prompt"
LABEL_SCHEMA = "category string, subcategory string, label_cn string, label_en string, ord int"
TEMPLATE_SCHEMA = "category string, tpl_no int, zh string, en string"


@dataclass(frozen=True)
class Vocabulary:
    """A vocabulary as rows; its size is that of a file which people write."""

    labels: tuple[tuple[str, str, str, str, int], ...]
    templates: tuple[tuple[str, int, str, str], ...]
    settings: dict

    @classmethod
    def parse(cls, text: str) -> Vocabulary:
        """Keys that start with ``_`` are comments. A category may hold labels without subcategories; it is then its own one."""
        tree = json.loads(text)
        if LABELS not in tree:
            raise ValueError(f"the vocabulary has no {LABELS}")
        labels, templates = [], []
        for category, subs in tree[LABELS].items():
            if category.startswith("_") or not isinstance(subs, dict):
                continue
            flat = {k: v for k, v in subs.items() if not isinstance(v, dict) and not k.startswith("_")}
            nested = {k: v for k, v in subs.items() if isinstance(v, dict) and not k.startswith("_")}
            for sub, entries in ({category: flat} | nested if flat else nested).items():
                before = sum(r[0] == category for r in labels)
                labels += [(category, sub, cn, en, before + i) for i, (cn, en) in enumerate(entries.items())]
        for category, rows in tree.get(TEMPLATES, {}).items():
            if not category.startswith("_"):
                pairs = [pair for row in rows for pair in row.items()]
                templates += [(category, i, zh, en) for i, (zh, en) in enumerate(pairs)]
        return cls(tuple(labels), tuple(templates), {k: v for k, v in tree.get(SETTINGS, {}).items() if not k.startswith("_")})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Vocabulary:
        return cls.parse(spark.read.text(path, wholetext=True).first()[0])

    @property
    def categories(self) -> list[str]:
        return list(dict.fromkeys(r[0] for r in self.labels))

    def label_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.labels), LABEL_SCHEMA)

    def template_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.templates), TEMPLATE_SCHEMA)

    def warnings(self) -> list[str]:
        """Differences between required categories, the tree and the verification texts."""
        required, have = set(self.settings.get(REQUIRED, ())), set(self.categories)
        asked = {k for k in self.settings.get(VERIFY, {}).get("zh", {}) if not k.startswith("_")}
        out = [f"required but not in the tree: {c}" for c in sorted(required - have)]
        out += [f"required but without a verification text: {c}" for c in sorted((required & have) - asked)]
        return out + [f"verification text without a category: {c}" for c in sorted(asked - have)]


def labels_from_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """LABEL_SCHEMA from a column of JSON trees (category -> subcategory -> label -> translation), without the driver."""
    tree = F.from_json(F.col(column), "map<string,map<string,map<string,string>>>")
    one = rows.select(F.explode(tree).alias("category", "subs")).where(~F.col("category").startswith("_"))
    two = one.select("category", F.posexplode("subs").alias("sub", "subcategory", "entries")).where(~F.col("subcategory").startswith("_"))
    three = two.select("category", "sub", "subcategory", F.posexplode("entries").alias("place", "label_cn", "label_en"))
    w = Window.partitionBy("category").orderBy("sub", "place")
    return three.select("category", "subcategory", "label_cn", "label_en", (F.row_number().over(w) - 1).alias("ord"))


def cache_hash(text: str, language: str, version: str = "prompts-1") -> str:
    """Eight hex digits that say from which vocabulary and language a prompt table was made."""
    return hashlib.md5(f"{version}\n{text}\n{language}".encode()).hexdigest()[:8]


def write_prompts(prompts: DataFrame, path: str, stamp: str) -> int:
    """Stores prompts with their vectors, and a manifest with stamp and number of rows; the number is checked when read."""
    prompts.write.mode("overwrite").parquet(f"{path}/rows")
    rows = prompts.sparkSession.read.parquet(f"{path}/rows")
    n = rows.count()
    prompts.sparkSession.createDataFrame([(stamp, n)], "stamp string, n long").write.mode("overwrite").parquet(f"{path}/manifest")
    return n


def read_prompts(spark: SparkSession, path: str, stamp: str, expected: int | None = None) -> DataFrame | None:
    """The stored prompts; None where they were made from something else or are not whole."""
    manifest = spark.read.parquet(f"{path}/manifest").first()
    rows = spark.read.parquet(f"{path}/rows")
    n = rows.count()
    return rows if manifest["stamp"] == stamp and manifest["n"] == n and expected in (None, n) else None


def prompts_by_category(prompts: DataFrame) -> DataFrame:
    """category and the sorted numbers of its prompts; prompts without a category are under ``?``."""
    return prompts.groupBy(F.coalesce("category", F.lit("?")).alias("category")).agg(F.array_sort(F.collect_list("prompt_idx")).alias("prompts"), F.count("*").alias("n"))


def prompt_info(prompts: DataFrame) -> DataFrame:
    """One row: number of prompts, of categories, and dimension."""
    return prompts.agg(F.count("*").alias("n_prompts"), F.count_distinct("category").alias("n_categories"), F.max(F.size("vec")).alias("dim"))


def prompt_batches(prompts: DataFrame, size: int) -> DataFrame:
    """Prompts with batch number, first and last row of it and number of batches, by ``prompt_idx``."""
    n = prompts.agg((F.max("prompt_idx") + 1).alias("total"))
    batch = F.floor(F.col("prompt_idx") / size).cast("long")
    out = prompts.crossJoin(F.broadcast(n)).withColumn("batch_idx", batch)
    return out.withColumns({"start_idx": batch * size, "end_idx": F.least((batch + 1) * size, F.col("total").cast("long")), "num_batches": F.ceil(F.col("total") / size).cast("long")})


def take_prompts(wanted: DataFrame, prompts: DataFrame) -> DataFrame:
    """Columns of prompts for each distinct number that is not negative; missing ones have nulls."""
    return wanted.where("prompt_idx >= 0").select("prompt_idx").distinct().join(prompts, "prompt_idx", "left")
