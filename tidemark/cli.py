"""A small shell on a table:  python -m tidemark.cli PATH [--policy leveled] [--serializable]

    fill FROM TO | put KEY VALUE | del KEY | get KEY | scan [FROM TO] | dump | flush | compact | full_compaction | quit

Both ends of ``fill`` and ``scan`` count.  ``fill`` writes value{i}@{n} under key i, n being the number of
commands so far.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable

from .functions.keys import ALL_KEYS, KeyRange, Put, included
from .plans.layout import NoCompaction
from .plans.simulator import POLICIES
from .sources.table import Options, VersionedTable


def run(table: VersionedTable, lines: Iterable[str], say=print) -> None:
    for n, line in enumerate(lines):
        word, *args = line.split() or [""]
        match word, args:
            case "fill", [first, last]:
                batch = [Put(str(i), f"value{i}@{n}") for i in range(int(first), int(last) + 1)]
                table.write_batch(batch)
                say(f"round {n} wrote {len(batch)} rows")
            case "put", [key, value]:
                table.put(key, value)
            case "del", [key]:
                table.delete(key)
            case "get", [key]:
                value = table.get(key)
                say(f"{key} does not exist" if value is None else f"{key}={value.decode(errors='replace')}")
            case "scan", ([] | [_, _]) as ends:
                keys = KeyRange(included(ends[0].encode()), included(ends[1].encode())) if ends else ALL_KEYS
                count = 0
                for r in table.scan(keys).toLocalIterator():
                    say(f"{bytes(r['key']).decode(errors='replace')}={bytes(r['value']).decode(errors='replace')}")
                    count += 1
                say(f"rows in range: {count}")
            case "dump", []:
                for r in table.describe().collect():
                    say(f"{r['place']} {r['number']}: file {r['file_id']}, {r['n_rows']} rows, {r['n_bytes']} bytes")
            case "flush", []:
                table.flush()
            case "compact", []:
                say("compacted" if table.compact() else "nothing to do")
            case "full_compaction", []:
                table.full_compaction()
            case ("quit" | "close"), []:
                table.close()
                return
            case _:
                say(f"not a command: {line.strip()}")


def main() -> None:
    from pyspark.sql import SparkSession

    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("path")
    p.add_argument("--policy", choices=["none", *POLICIES], default="leveled")
    p.add_argument("--serializable", action="store_true")
    p.add_argument("--no-log", action="store_true", help="keep writes in memory until a flush")
    a = p.parse_args()
    policy = NoCompaction() if a.policy == "none" else POLICIES[a.policy]()
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    table = VersionedTable.at(spark, a.path, Options(policy=policy, serializable=a.serializable, durable_writes=not a.no_log))
    table.start_background()
    run(table, sys.stdin)
    table.close()


if __name__ == "__main__":
    main()
