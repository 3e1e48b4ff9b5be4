"""python -m foliospark extract text|csv|rows|tables, info, audit, infer schema: prints what the API gives.

Several inputs are a batch: one that fails is left out with warning W998, and only a batch of which none is left fails; JSON of
several inputs is an array, which may be empty; JSON lines have a line for each input, failed or not. Warnings go to stderr. Exit
codes: 0 done, 1 failed with ``error[code]: message``, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from foliospark import api
from foliospark import errors as E


def parser() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--quiet", "-q", action="store_true", default=argparse.SUPPRESS, help="no warnings")
    shared.add_argument("--warnings", choices=("text", "json", "none"), default=argparse.SUPPRESS)
    out = argparse.ArgumentParser(prog="foliospark", description=__doc__, parents=[shared])
    top = out.add_subparsers(dest="command", required=True)
    extract = top.add_parser("extract", parents=[shared]).add_subparsers(dest="what", required=True)

    def selectors(own) -> None:
        which = own.add_mutually_exclusive_group()
        which.add_argument("--sheet")
        which.add_argument("--sheet-index", type=_positive)
        own.add_argument("--include-hidden", action="store_true")

    own = extract.add_parser("text", parents=[shared])
    own.add_argument("files", nargs="+")
    own.add_argument("--format", choices=("text", "json", "jsonl", "structured-json"), default="text")
    own.add_argument("--output", "-o")
    own = extract.add_parser("csv", parents=[shared])
    own.add_argument("files", nargs="+")
    which = own.add_mutually_exclusive_group()
    which.add_argument("--sheet")
    which.add_argument("--sheet-index", type=_positive)
    which.add_argument("--list-sheets", action="store_true")
    which.add_argument("--all-sheets", action="store_true")
    own.add_argument("--include-hidden", action="store_true")
    own.add_argument("--delimiter", default=",")
    own.add_argument("--value-mode", choices=("raw", "formatted"), default="raw")
    where = own.add_mutually_exclusive_group()
    where.add_argument("--output", "-o")
    where.add_argument("--output-dir")
    own = extract.add_parser("rows", parents=[shared])
    own.add_argument("files", nargs=1)
    own.add_argument("--format", choices=("jsonl",), default="jsonl")
    selectors(own)
    own.add_argument("--value-mode", choices=("raw", "formatted"), default="raw")
    own = extract.add_parser("tables", parents=[shared])
    own.add_argument("files", nargs=1)
    own.add_argument("--format", choices=("json",), default="json")
    own = top.add_parser("info", parents=[shared])
    own.add_argument("files", nargs=1)
    own.add_argument("--format", choices=("json", "text"), default="json")
    own = top.add_parser("audit", parents=[shared])
    own.add_argument("files", nargs="+")
    own.add_argument("--format", choices=("json", "jsonl", "text"), default="json")
    own = top.add_parser("infer", parents=[shared]).add_subparsers(dest="what", required=True).add_parser("schema", parents=[shared])
    own.add_argument("files", nargs=1)
    selectors(own)
    own.add_argument("--sample-rows", type=_positive)
    return out


def _positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("must be 1 or greater")
    return n


def parse(argv: list[str] | None) -> argparse.Namespace:
    own = parser()
    a = own.parse_args(argv)
    if getattr(a, "all_sheets", False) != (getattr(a, "output_dir", None) is not None):
        own.error("--all-sheets and --output-dir need each other")
    if getattr(a, "all_sheets", False) and a.output:
        own.error("--all-sheets doesn't go with --output")
    a.warnings = "none" if getattr(a, "quiet", False) else getattr(a, "warnings", "text")
    return a


def _fail(message: str) -> E.EngineError:
    return E.EngineError(E.ARGUMENT, message)


class Run:
    """The inputs of a call, by number so that a file may be given twice, and what they give, in the order of the call."""

    def __init__(self, spark, a: argparse.Namespace):
        self.a, self.names, content, self.failed = a, ["<stdin>" if f == "-" else Path(f).name for f in a.files], [], {}
        stdin = None
        for i, f in enumerate(a.files):
            try:
                if f == "-":
                    stdin = sys.stdin.buffer.read() if stdin is None else stdin
                content.append((f"{i:06d}/{self.names[i]}", stdin if f == "-" else Path(f).read_bytes()))
            except OSError as e:
                self.failed[i] = {"code": E.IO, "message": f"I/O error: {e.strerror}"}
        self.pk = api.from_bytes(spark, content) if content else spark.createDataFrame([], "path string, length bigint, content binary")
        self.lines: list[str] = []

    def number(self, path: str) -> int:
        return int(path[:6])

    def warn(self, found) -> None:
        for line in api.warning_lines(found or (), self.a.warnings):
            print(line, file=sys.stderr)

    def each(self, df) -> list[tuple[int, object]]:
        """The inputs' rows in order. Failed ones: the only input ends the run, of several each is left out with a warning."""
        rows = {self.number(r.path): r for r in df.toLocalIterator()}
        out = []
        for i in range(len(self.names)):
            error = self.failed.get(i) or rows[i].error
            if error is None:
                self.warn(rows[i].warnings)
                out.append((i, rows[i]))
            elif len(self.names) > 1:
                self.warn([api.skipped(self.names[i], error)])
            else:
                raise E.EngineError(error["code"], error["message"])
        return out

    def json(self, found: list, value) -> None:
        """One object for one input, an array for several."""
        made = [value(i, r) for i, r in found]
        self.lines.append(json.dumps(made if len(self.names) > 1 else made[0], ensure_ascii=False, indent=2) + "\n")


def _of(row, name: str) -> dict:
    """A JSON form's text with the input's own name."""
    return json.loads(row.value) | {"file": name}


def _text(run: Run) -> None:
    form = run.a.format
    if form == "jsonl":
        rows = {run.number(r.path): json.loads(r.value) for r in api.text_jsonl(run.pk).toLocalIterator()}
        for i, name in enumerate(run.names):
            own = rows.get(i) or {"document_type": "unknown", "error": run.failed[i]}
            run.lines.append(json.dumps({"file": name} | {k: v for k, v in own.items() if k != "file"}, ensure_ascii=False, separators=(",", ":")) + "\n")
        return
    structured = form == "structured-json"
    found = run.each(api.structured_text(run.pk, mode="permissive") if structured else api.extract_text(run.pk, mode="permissive"))
    if structured:
        run.json(found, lambda i, r: {"file": run.names[i], "document_type": r.document_type, "blocks": [b.asDict() for b in r.blocks]})
    elif form == "json":
        run.json(found, lambda i, r: {"file": run.names[i], "text": r.text})
    elif found:
        run.lines.append("\n---\n".join(r.text for _, r in found))
    else:
        raise _fail("no input files were processed successfully")


def _csv(run: Run) -> int:
    a, many = run.a, len(run.names) > 1
    formatted = a.value_mode == "formatted"
    if many and (a.list_sheets or a.all_sheets):
        raise _fail(f"--{'list' if a.list_sheets else 'all'}-sheets supports a single input file")
    api.parse_delimiter(a.delimiter)
    if a.all_sheets:
        rows = api.export_all_sheets(run.pk, a.output_dir, a.delimiter, formatted, a.include_hidden, flat=True).collect() if not run.failed else []
        if error := run.failed.get(0) or next((r.error for r in rows if r["index"] is None), None):
            raise E.EngineError(error["code"], error["message"])
        for r in rows:
            run.warn(r.warnings)
        return 1 if any(r.error for r in rows) else 0
    if a.list_sheets:
        from foliospark.operators import shred

        for _, r in run.each(shred.sheets(run.pk, a.include_hidden, api.LIMITS, "permissive")):
            run.lines += [f"{s['index']}: {s['name']}" + (f" ({s['visibility']})" if a.include_hidden else "") + "\n" for s in r.sheets]
        return 0
    from pyspark.sql import functions as F

    from foliospark.functions import cells as C

    options = {"sheet": a.sheet, "sheet_index": a.sheet_index, "include_hidden": a.include_hidden, "formatted": formatted, "mode": "permissive"}
    line = F.when(F.col("row_ord").isNotNull(), C.csv_line(F.col("cells"), F.col("date1904"), api.parse_delimiter(a.delimiter), formatted))
    done, lines = {}, {}
    for r in api.scan_rows(run.pk, **options).select("path", "row_ord", line.alias("line"), "warnings", "error").toLocalIterator():
        if r.row_ord is None:
            done[run.number(r.path)] = r
        else:
            lines.setdefault(run.number(r.path), []).append((r.row_ord, r.line))
    processed = 0
    for i, name in enumerate(run.names):
        run.lines += [f"{x}\n" for _, x in sorted(lines.get(i, ()))]  # rows before a failure stay
        error = run.failed.get(i) or done[i].error
        if error is None:
            processed += 1
            run.warn(done[i].warnings)
        elif many:
            run.warn([api.skipped(name, error)])
        else:
            raise E.EngineError(error["code"], error["message"])
    if not processed:
        raise _fail("no input files were processed successfully")
    return 0


def _audit(run: Run) -> None:
    form = run.a.format
    if form == "jsonl":
        rows = {run.number(r.path): json.loads(r.value) for r in api.audit_jsonl(run.pk).toLocalIterator()}
        for i, name in enumerate(run.names):
            own = rows.get(i) or {"schema_version": 1, "document_type": "unknown", "error": run.failed[i]}
            if "audit" in own:
                own["audit"] |= {"file": name, "metadata": own["audit"]["metadata"] | {"file": name}}
            run.lines.append(json.dumps({"schema_version": 1, "file": name} | {k: v for k, v in own.items() if k != "file"}, ensure_ascii=False, separators=(",", ":")) + "\n")
        return
    found = run.each(api.read_audit(run.pk, mode="permissive"))
    made = {run.number(r.path): json.loads(r.value) for r in api.audit_json(run.pk, mode="dropmalformed").toLocalIterator()}
    if form == "json":
        run.json(found, lambda i, r: made[i] | {"file": run.names[i], "metadata": made[i]["metadata"] | {"file": run.names[i]}})
        return
    for i, r in found:
        head = [f"file: {run.names[i]}"] if len(run.names) > 1 else []
        run.lines += [f"{x}\n" for x in (*head, f"signal_count: {len(r.signals)}", *(f"- {s.severity} {s.kind} {s.path}: {s.message}" for s in r.signals))]
    if not found:
        raise _fail("no input files were processed successfully")


def _single(run: Run) -> None:
    """The commands for one input."""
    a = run.a
    if run.failed:
        raise E.EngineError(**run.failed[0])
    if a.command == "info":
        run.each(api.read_info(run.pk, mode="permissive"))
        if a.format == "json":
            run.lines.append(json.dumps(_of(api.info_json(run.pk).first(), run.names[0]), ensure_ascii=False, indent=2) + "\n")
        else:
            run.lines += [f"file: {run.names[0]}\n" if r.line.startswith("file: ") else f"{r.line}\n" for r in api.info_text(run.pk).toLocalIterator()]
    elif a.what == "tables":
        run.each(api.docx_tables(run.pk, mode="permissive"))
        run.lines.append(json.dumps(_of(api.tables_json(run.pk).first(), run.names[0]), ensure_ascii=False, indent=2) + "\n")
    else:
        options = {"sheet": a.sheet, "sheet_index": a.sheet_index, "include_hidden": a.include_hidden}
        formatted = a.command == "infer" or a.value_mode == "formatted"
        state = api.scan_rows(run.pk, formatted=formatted, mode="permissive", max_rows=getattr(a, "sample_rows", None), **options).where("row_ord is null").first()
        if state.error:
            raise E.EngineError(state.error.code, state.error.message)
        run.warn(state.warnings)
        if a.command == "infer":
            row = api.schema_report(run.pk, a.sample_rows, **options).first()
            run.lines.append(json.dumps(_of(row, run.names[0]) if row else {"file": run.names[0], "columns": []}, ensure_ascii=False, indent=2) + "\n")
        else:
            rows = api.rows_jsonl(run.pk, formatted=formatted, **options).orderBy("row_ord").toLocalIterator()
            shown = json.dumps(run.pk.first().path, ensure_ascii=False), json.dumps(run.names[0], ensure_ascii=False)
            run.lines += [r.value.replace(*shown, 1) + "\n" for r in rows]


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    a = parse(argv)
    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    code = 0
    try:
        run = Run(spark, a)
        if a.command == "extract" and a.what == "text":
            _text(run)
        elif a.command == "extract" and a.what == "csv":
            code = _csv(run)
        elif a.command == "audit":
            _audit(run)
        else:
            _single(run)
    except Exception as e:
        print(f"error[{getattr(e, 'code', E.IO)}]: {getattr(e, 'message', str(e).splitlines()[0] if str(e) else type(e).__name__)}", file=sys.stderr)
        code = 1
        if not getattr(a, "what", None) == "csv":
            return code
        run = locals().get("run") or argparse.Namespace(lines=[])
    text = "".join(run.lines)
    if getattr(a, "output", None):
        if code == 0 or text:
            Path(a.output).write_text(text, encoding="utf-8", newline="")
    else:
        print(text, end="")
    return code


if __name__ == "__main__":
    sys.exit(main())
