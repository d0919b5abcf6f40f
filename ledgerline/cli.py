"""The interactive shell: python -m ledgerline.cli [directory]."""

from __future__ import annotations

import sys

HELP = """Commands:
  put <key> <value>   store a value
  get <key>           show a key's value
  del <key>           delete a key
  flush               write pending operations to a run
  stats               pending entries and runs
  help                this list
  exit, quit          leave"""


def run(store, lines, say=print) -> None:
    """Carry out commands until exit, quit or the end of lines."""
    for line in lines:
        words = line.split(None, 2)
        if not words:
            continue
        command, key = words[0], words[1].encode() if len(words) > 1 else b""
        if command in ("exit", "quit"):
            say("Closing.")
            return
        if command == "help":
            say(HELP)
        elif command == "put":
            value = words[2].rstrip("\n").encode() if len(words) > 2 else b""
            if not key or not value:
                say("Usage: put <key> <value>")
                continue
            store.put(key, value)
            say(f"OK {key.decode()} => {value.decode()}")
        elif command == "get":
            if not key:
                say("Usage: get <key>")
                continue
            value = store.get(key)
            say(f"NOT FOUND {key.decode()}" if value is None else f"FOUND {key.decode()} => {value.decode(errors='replace')}")
        elif command == "del":
            if not key:
                say("Usage: del <key>")
                continue
            store.delete(key)
            say(f"DELETED {key.decode()}")
        elif command == "flush":
            store.flush()
            say("FLUSHED")
        elif command == "stats":
            stats = store.stats()
            say(f"pending entries: {stats['memtable_entries']}\nruns: {stats['runs']}")
        else:
            say(f"Unknown command: {command}. Type help for the list.")


def main(args: list[str]) -> None:
    from pyspark.sql import SparkSession

    from ledgerline.store import Store

    spark = SparkSession.builder.appName("ledgerline").getOrCreate()
    with Store(spark, args[0] if args else "ledgerline-store") as store:
        print(HELP)
        run(store, sys.stdin)


if __name__ == "__main__":
    main(sys.argv[1:])
