"""Command line: check a configuration, select clips of a corpus folder."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from korpuslab import __version__
from korpuslab.errors import ConfigError
from korpuslab.operators.selection import select_clips
from korpuslab.session import build_session
from korpuslab.sources.config import load_config
from korpuslab.sources.files import write_json


def _validate(args: argparse.Namespace) -> str:
    return json.dumps(load_config(args.config).to_dict(), ensure_ascii=False, sort_keys=True, indent=2)


def _select(args: argparse.Namespace) -> str:
    manifest = select_clips(build_session(), args.root, limit=args.limit, seed=args.seed, source_version=args.source_version, split=args.split)
    write_json(args.output, manifest.to_dict())
    return f"wrote {args.output}"


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="korpuslab")
    parser.add_argument("--version", action="version", version=__version__)
    groups = parser.add_subparsers(required=True)
    validate = groups.add_parser("config").add_subparsers(required=True).add_parser("validate")
    validate.add_argument("--config", required=True)
    validate.set_defaults(run=_validate)
    select = groups.add_parser("data").add_subparsers(required=True).add_parser("select-clips")
    for name, kind in (("root", str), ("output", str), ("limit", int), ("seed", int), ("source-version", str)):
        select.add_argument(f"--{name}", required=True, type=kind)
    select.add_argument("--split")
    select.set_defaults(run=_select)
    return parser


def main(argv: Sequence[str] | None = None) -> int:
    """0 if it worked, 2 with a message on the error stream if it did not."""
    args = _arguments().parse_args(argv)
    try:
        print(args.run(args))
    except (ConfigError, FileNotFoundError, ValueError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
