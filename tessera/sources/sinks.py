"""Sinks: a content-addressed cache, a swapped table, the corpus for a reader without Spark, suites."""

from __future__ import annotations

import json
import re
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cache_raw(raw: DataFrame, folder: str) -> None:
    """Write contents (content: binary) once per SHA-256 below ``folder``; what is there is not written
    again. The hash's first two digits are the partition, so a lookup reads one 256th."""
    spark = raw.sparkSession
    new = raw.select(F.sha2("content", 256).alias("sha256"), "content").dropDuplicates(["sha256"])
    try:
        new = new.join(spark.read.parquet(folder).select("sha256"), "sha256", "left_anti")
    except Exception as e:  # noqa: BLE001 - the reader's error for a folder that is not there yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    new.withColumn("part", F.left("sha256", F.lit(2))).write.partitionBy("part").mode("append").parquet(folder)


def replace_table(df: DataFrame, folder: str, version: str) -> str:
    """Write a table's next version beside the old ones, then name it current: readers never see half
    a table, and a failed write changes nothing."""
    path = f"{folder.rstrip('/')}/{version}"
    df.write.mode("overwrite").parquet(path)
    spark = df.sparkSession
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{folder.rstrip('/')}/_current")
    return path


def current_table(spark: SparkSession, folder: str) -> DataFrame:
    version = spark.read.json(f"{folder.rstrip('/')}/_current").first()["version"]
    return spark.read.parquet(f"{folder.rstrip('/')}/{version}")


def export_corpus(passages: DataFrame, sources: DataFrame, folder: str) -> None:
    """Two folders of JSON lines: ``sources``, and ``passages`` by source in order. A source may hold a
    tenth of the corpus, so its passages are lines of their own, range-partitioned: a large source
    takes several files, whose names follow their order."""
    folder = folder.rstrip("/")
    sources.write.mode("overwrite").json(f"{folder}/sources")
    order = ["source_id", "document_id", "ordinal", "chunk_id"]
    cols = [c for c in order if c in passages.columns]
    listed = passages.select(*cols, "section", "text").repartitionByRange(*cols).sortWithinPartitions(*cols)
    listed.write.mode("overwrite").json(f"{folder}/passages")


def read_suites(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(suite, question_id, type, question, graders) of suite files in JSON; missing files are skipped,
    a question needs a grader, ids are unique."""
    rows = []
    for p in map(Path, paths):
        if p.is_file():
            suite = json.loads(p.read_text(encoding="utf-8"))
            for q in suite.get("questions", []):
                if not q.get("graders"):
                    raise ValueError(f"question {q.get('id')!r} has no grader")
                rows.append((suite.get("suite", p.stem), q["id"], q.get("type", "factual"), q["question"], json.dumps(q["graders"])))
    if len({r[1] for r in rows}) != len(rows):
        raise ValueError("a question id is used twice")
    return spark.createDataFrame(rows, "suite string, question_id string, type string, question string, graders string")


def write_json(value: dict, path: str) -> bool:
    """Write a small record where it is not there yet or differs; whether it was written. What is equal
    is left alone, so that a repeated run changes no file."""
    target = Path(path)
    text = json.dumps(value, indent=2, sort_keys=True, default=str, ensure_ascii=False)
    if target.is_file() and target.read_text(encoding="utf-8") == text:
        return False
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_suffix(target.suffix + ".part")
    part.write_text(text, encoding="utf-8")
    part.replace(target)
    return True


def report_record(version: str, metrics: DataFrame, by_type: DataFrame, failures: DataFrame, passed: bool) -> dict:
    """An evaluation's report (metrics: metric, value; by_type: qtype, total, passed; failures: question_id):
    as many rows as metrics, types and questions of a suite, hence a record."""
    kinds = {r["qtype"]: {"total": r["total"], "passed": r["passed"]} for r in by_type.orderBy("qtype").collect()}
    return {
        "version": version, "passed": passed, "metrics": {r["metric"]: r["value"] for r in metrics.orderBy("metric").collect()}, "by_type": kinds,
        "failures": [r["question_id"] for r in failures.orderBy("question_id").collect()],
    }


def write_report(report: dict, folder: str, publish: bool = False) -> None:
    """A report as the latest one and, where its version is published, as the baseline and in the log of versions."""
    root = Path(folder)
    write_json(report, str(root / "reports" / "latest.json"))
    if publish:
        write_json(report, str(root / "baseline.json"))
        write_json(report, str(root / "versions" / f"{report['version']}.json"))


def version_log(folder: str) -> list[dict]:
    """The published records, newest version first; a file that is no record is left out."""
    out = []
    for p in (Path(folder) / "versions").glob("v*.json"):
        try:
            out.append(json.loads(p.read_text(encoding="utf-8")))
        except ValueError:
            continue
    return sorted(out, key=lambda r: tuple(int(x) for x in r["version"][1:].split(".")), reverse=True)


def export_static(tables: dict[str, DataFrame], folder: str) -> None:
    """A page's data without a server: each report table as a folder of JSON lines, and an index of
    their columns."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder.rstrip('/')}/api/{name}")
    write_json({n: df.columns for n, df in tables.items()}, str(Path(folder.removeprefix("file://")) / "index.json"))


def export_challenges(challenges: DataFrame, folder: str) -> None:
    """Challenges as JSON lines, a folder for each status."""
    challenges.write.mode("overwrite").partitionBy("status").json(folder)


def import_challenges(stored: DataFrame, folder: str, key: list[str]) -> DataFrame:
    """Stored challenges with those of the files put in by key: where both have one, the files win."""
    files = stored.sparkSession.read.schema(stored.schema).option("basePath", folder).json(folder).select(*stored.columns).dropDuplicates(key)
    return stored.join(files.select(*key), key, "left_anti").unionByName(files)


def write_register(documents: DataFrame, identity: dict, facts: dict, folder: str) -> None:
    """A collected area's register: its documents as ``sources`` (JSON lines), who it was matched to and
    what was found as two records."""
    documents.write.mode("overwrite").json(f"{folder.rstrip('/')}/sources")
    root = Path(folder.removeprefix("file://"))
    write_json(identity, str(root / "identity.json"))
    write_json(facts, str(root / "collection.json"))


def instantiate(template: str, params: dict[str, str], into: str, force: bool = False) -> Path:
    """A copy of a template folder with ``{{ name }}`` in its text files filled in. ``template.json`` names
    the parameters and the id's pattern; a parameter that is missing or unknown is an error, as is an id
    of other than small letters, digits and hyphens, and a folder that is already there without ``force``."""
    source = Path(template)
    spec = json.loads((source / "template.json").read_text(encoding="utf-8"))
    missing = [p for p in spec.get("parameters", []) if not params.get(p)]
    if missing:
        raise ValueError(f"template {template!r} needs the parameters {', '.join(missing)}")

    def filled(text: str, values: dict[str, str]) -> str:
        def one(m: re.Match) -> str:
            if m[1] not in values:
                raise ValueError(f"template {template!r} uses the unknown parameter {m[1]!r}")
            return str(values[m[1]])

        return re.sub(r"\{\{\s*(\w+)\s*\}\}", one, text)

    name = filled(spec["id"], params).strip()
    if not re.fullmatch(r"[a-z0-9][a-z0-9-]*", name):
        raise ValueError(f"template {template!r} gives the invalid id {name!r}")
    target = Path(into) / name
    if target.exists():
        if not force:
            raise FileExistsError(f"{target} is there already")
        shutil.rmtree(target)
    for p in sorted(source.rglob("*")):
        if p.is_file() and p.name != "template.json":
            out = target / p.relative_to(source)
            out.parent.mkdir(parents=True, exist_ok=True)
            if p.suffix in (".json", ".md", ".txt", ".csv", ".html", ".sql"):
                out.write_text(filled(p.read_text(encoding="utf-8"), {**params, "id": name}), encoding="utf-8")
            else:
                shutil.copyfile(p, out)
    write_json({"template": source.name, "id": name, "params": params}, str(target / "instance.json"))
    return target
