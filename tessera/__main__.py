"""``convert CSV TABLE [SCHEMA] [--lines]`` (--lines: no row spans lines) and ``query DIR NAME``."""

from __future__ import annotations

import sys
import time

from tessera.plans import catalog
from tessera.session import local_session
from tessera.sources.display import display_lines
from tessera.sources.ingest import convert


def main(args: list[str]) -> int:
    plain = [x for x in args if x != "--lines"]
    if plain[:1] == ["convert"] and len(plain) in (3, 4):
        began = time.perf_counter()
        convert(local_session(), plain[1], plain[2], plain[3] if len(plain) == 4 else None, multi_line=False if "--lines" in args else None)
        print(f"converted in {(time.perf_counter() - began) * 1000:.0f} ms", file=sys.stderr)
        return 0
    if args[:1] == ["query"] and len(args) == 3 and args[2] in catalog.QUERIES:
        spark = local_session()
        began = time.perf_counter()
        for line in display_lines(catalog.QUERIES[args[2]].frame(spark, args[1]).df):
            print(line)
        print(f"{args[2]} completed in {(time.perf_counter() - began) * 1000:.0f} ms", file=sys.stderr)
        return 0
    print(f"{__doc__}\nQueries: {', '.join(catalog.QUERIES)}", file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
