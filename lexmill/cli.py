"""Command line: chunk, structure, explain or review one document."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import chunks, pages, trace
from .plans.profiles import chunk_policy, resolve
from .sources import files


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexmill")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("chunk", "structure", "explain", "review"):
        own = commands.add_parser(name)
        source = own.add_mutually_exclusive_group(required=True)
        source.add_argument("--text")
        source.add_argument("--path")
        own.add_argument("--profile", default="generic")
        own.add_argument("--doc-kind", default=None)
        own.add_argument("--output", default=None)
        if name == "review":
            own.add_argument("--limit", type=int, default=20)
            own.add_argument("--max-chars", type=int, default=240)
    return top


def load(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    if given.text is not None:
        return spark.createDataFrame([(0, "<memory>", given.text)], "doc_id long, source_name string, text string")
    if Path(given.path).suffix.lower() == ".pdf":
        found = files.pdf_pages(spark, given.path)
        return pages.document_text(found, given.profile).withColumn("source_name", F.lit(Path(given.path).name))
    return spark.createDataFrame([(0, Path(given.path).name, Path(given.path).read_text(encoding="utf-8"))], "doc_id long, source_name string, text string")


def payload(docs: DataFrame, given: argparse.Namespace) -> dict:
    own, policy = resolve(given.profile), chunk_policy(given.profile, given.doc_kind)
    row = chunks.documents(docs, own, given.doc_kind).head().asDict(recursive=True)
    found = {"source_name": row["source_name"], "profile": own.code, "language": own.language, "chunk_policy": policy}
    if given.command == "chunk":
        return found | {"chunks": row["chunks"] or []}
    if given.command == "structure":
        return found | {"sections": row["sections"] or []}
    told = trace.events(docs, own, given.doc_kind).orderBy("stage", "position", "type").drop("doc_id")
    return found | {"trace": {"events": [r.asDict() for r in told.collect()]}}


def review(docs: DataFrame, given: argparse.Namespace) -> str:
    own = resolve(given.profile)
    row = chunks.documents(docs, own, given.doc_kind)
    short = lambda x: F.transform(x, lambda e: e.withField("preview", text.preview(e["text"], given.max_chars)))
    r = row.withColumns({"sections": short(F.coalesce("sections", F.array().cast(row.schema["sections"].dataType))), "chunks": short(F.coalesce("chunks", F.array().cast(row.schema["chunks"].dataType)))}).head()
    out = [f"Source: {r.source_name}", f"Profile: {r.profile}", f"Language: {r.language or 'unknown'}", f"Chunk policy: {r.chunk_policy}", f"Sections: {len(r.sections)}", f"Chunks: {len(r.chunks)}", "", "Sections"]
    for s in r.sections[: given.limit]:
        out += [f"[{s.order}] {s.title} | kind={s.kind} | type={s.section_type or '-'}", f"  preview: {s.preview}"]
    if len(r.sections) > given.limit:
        out.append(f"  ... {len(r.sections) - given.limit} more sections")
    out += ["", "Chunks"]
    for c in r.chunks[: given.limit]:
        out += [f"[{c.order}] {c.section_title or '-'} | method={c.chunk_method} | chunk_id={c.chunk_id}", f"  preview: {c.preview}"]
    if len(r.chunks) > given.limit:
        out.append(f"  ... {len(r.chunks) - given.limit} more chunks")
    return "\n".join(out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lexmill").getOrCreate()
    docs = load(spark, given)
    content = review(docs, given) if given.command == "review" else json.dumps(payload(docs, given), ensure_ascii=False, indent=2)
    if given.output is None:
        print(content)
    else:
        Path(given.output).parent.mkdir(parents=True, exist_ok=True)
        Path(given.output).write_text(content + "\n", encoding="utf-8")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
