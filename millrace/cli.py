"""Command line: fetch, process, embed, verify, query, evaluate."""

from __future__ import annotations

import argparse
import importlib.util
import json
import logging

from pyspark.sql import functions as F

from millrace.config import ChunkingConfig, TokenizerFile
from millrace.operators import coverage, search
from millrace.plans import fetch, process
from millrace.session import get_session
from millrace.sources import readers

log = logging.getLogger("millrace")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="millrace")
    parser.add_argument("--log-file", help="log to this file as well")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("process")
    p.add_argument("input_folder")
    p.add_argument("output_folder")
    p.add_argument("--tokenizer", help="a tokenizer.json that counts tokens, in place of words")
    p = sub.add_parser("fetch")
    p.add_argument("registry")
    p.add_argument("output_folder")
    p.add_argument("--category", action="append", default=[], help="a source whose listed links are fetched, not crawled")
    for name in ("embed", "verify", "evaluate"):
        p = sub.add_parser(name)
        p.add_argument("--chunks", required=True)
        p.add_argument("--output-folder", default=".")
        p.add_argument("--model", default="hashing")
        p.add_argument("--batch-size", type=int, default=32)
        p.add_argument("--top-k", type=int, default=5)
        p.add_argument("--cases")
    p = sub.add_parser("query")
    p.add_argument("question")
    p.add_argument("--output-folder", default=".")
    p.add_argument("--model", default="hashing")
    p.add_argument("--top-k", type=int, default=5)
    a = parser.parse_args(argv)
    handlers = [logging.StreamHandler(), *([logging.FileHandler(a.log_file, encoding="utf-8")] if a.log_file else [])]
    logging.basicConfig(level=logging.INFO, format="%(asctime)s | %(levelname)s | %(message)s", handlers=handlers)
    spark = get_session()
    if a.command == "process":
        config = ChunkingConfig(tokens=TokenizerFile(a.tokenizer)) if a.tokenizer else ChunkingConfig()
        reader = readers.pypdf_pages if importlib.util.find_spec("pypdf") else None
        print(json.dumps(process.process_documents(spark, a.input_folder, a.output_folder, config, reader), indent=2))
    elif a.command == "fetch":
        counts = fetch.fetch_sources(spark, readers.read_registry(spark, a.registry), readers.http_get, a.output_folder, tuple(a.category))
        print(json.dumps(counts, indent=2))
    elif a.command == "embed":
        print(json.dumps(process.build_index(spark, a.chunks, a.output_folder, None, a.model, a.batch_size), indent=2))
    elif a.command == "query":
        index, row = process.load_index(spark, a.output_folder)
        hits = search.search_chunks(index, a.question, a.top_k, None, a.model, row)
        for line in search.render_hits(hits).orderBy("rank").collect():
            print(line["line"])
    elif a.command == "verify":
        index, row = process.load_index(spark, a.output_folder)
        cases = readers.read_cases(spark, a.cases) if a.cases else None
        chunks = readers.read_ready_chunks(spark, a.chunks)
        print(json.dumps(search.verify_index(spark, chunks, index, row["dimension"], cases, None, a.top_k), indent=2))
    else:
        chunks = readers.read_ready_chunks(spark, a.chunks)
        rows = coverage.case_coverage(readers.read_cases(spark, a.cases), chunks).cache()
        report = coverage.corpus_coverage(rows, chunks.count()).first().asDict()
        report["cases"] = [r.asDict() for r in rows.orderBy(F.col("id")).collect()]
        print(json.dumps(report, indent=2))
    log.info("%s finished", a.command)


if __name__ == "__main__":
    main()
