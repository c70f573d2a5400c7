"""python -m sahifa.cli --index PATH --query Q: search an index, with the hits as JSON."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .engine import Engine, SearchOptions, result_json
from .operators.index import load_index

_SWITCHES = {"prefix": "allow_prefix", "suffix": "allow_suffix", "wildcard": "allow_wildcard", "fuzzy": "allow_fuzzy"}
_FORMS = {"diacritics": "ignore_diacritics", "hamza-forms": "ignore_hamza_forms", "letter-forms": "ignore_letter_forms", "digit-forms": "ignore_digit_forms"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--index", required=True)
    p.add_argument("--query", required=True)
    p.add_argument("--field", choices=("page", "title", "both"), default="both")
    p.add_argument("--limit", type=int, default=20)
    for name in _SWITCHES:
        p.add_argument(f"--disable-{name}-search", action="store_true")
    for name in _FORMS:
        p.add_argument(f"--respect-{name}", action="store_true")
    for name in ("suffix", "wildcard"):
        p.add_argument(f"--{name}-max-expansions", type=int, default=256)
    p.add_argument("--fuzzy-max-expansions", type=int, default=128)
    p.add_argument("--lenient-parse-errors", action="store_true")
    p.add_argument("--explain", action="store_true")
    return p


def options_of(args: argparse.Namespace) -> SearchOptions:
    given = vars(args)
    values = {option: not given[f"disable_{name}_search"] for name, option in _SWITCHES.items()}
    values |= {option: not given[f"respect_{name.replace('-', '_')}"] for name, option in _FORMS.items()}
    if args.respect_hamza_forms and not args.respect_letter_forms:
        values["ignore_letter_forms"] = None  # letter forms follow hamza forms
    return SearchOptions(**values, suffix_expansions=args.suffix_max_expansions, wildcard_expansions=args.wildcard_max_expansions, fuzzy_expansions=args.fuzzy_max_expansions, lenient=args.lenient_parse_errors)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("sahifa").getOrCreate()
    options = options_of(args)
    engine = Engine(load_index(spark, args.index), options)
    if args.explain:
        import json

        print(json.dumps(engine.explain(args.query, args.field, args.limit), ensure_ascii=False))
    else:
        print(result_json(engine.search(args.query, args.field, args.limit), args.query, args.field, options))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
