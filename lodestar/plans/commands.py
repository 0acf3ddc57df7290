"""Commands as lists of texts, for scripts and terminals. Each runs on the driver and calls the engine."""

from __future__ import annotations

from collections.abc import Callable

from lodestar.errors import StatusError
from lodestar.functions.codecs import LOWER, UPPER, float_text, text_metric, text_uint64, text_vector
from lodestar.functions.resp import Failure, Simple
from lodestar.options import IndexOptions, SearchOptions
from lodestar.plans.engine import Engine, signed

# fixed values: usage lines of replies to a wrong number of arguments, and how many are right
USAGE = {
    "VCREATE": ("VCREATE <index> <dimension> <metric> [max_degree] [ef_construction]", range(4, 7)),
    "VDROP": ("VDROP <index>", range(2, 3)),
    "VHASINDEX": ("VHASINDEX <index>", range(2, 3)),
    "VPUT": ("VPUT <index> <id> <vector_csv> [payload]", range(4, 6)),
    "VGET": ("VGET <index> <id>", range(3, 4)),
    "VDEL": ("VDEL <index> <id>", range(3, 4)),
    "VSEARCH": ("VSEARCH <index> <vector_csv> <top_k> [ef_search] [WITHPAYLOADS]", range(4, 7)),
    "VSTATS": ("VSTATS <index>", range(2, 3)),
}


class Refused(Exception):
    pass


def upper(s: str) -> str:
    return s.translate(str.maketrans(LOWER, UPPER))


def needed(value, what: str):
    if value is None:
        raise Refused(f"invalid {what}")
    return value


def count(text: str, what: str, least: int = 0) -> int:
    value = needed(text_uint64(text), what)
    if value < least:
        raise Refused(f"invalid {what}")
    return value


class Commands:
    def __init__(self, engine: Engine, server: str = "lodestar", bind: str = "127.0.0.1", port: int = 6380):
        self.engine, self.server, self.bind, self.port = engine, server, bind, port
        self.closed = False

    def execute(self, args: list[str]):
        """The reply to a command; its name may be in either case."""
        if not args:
            return Failure("ERR empty command")
        name = upper(args[0])
        run: Callable | None = getattr(self, f"do_{name.lower()}", None) if name.isascii() and name.isalpha() else None
        if run is None:
            return Failure("ERR unknown command")
        if name in USAGE and len(args) not in USAGE[name][1]:
            return Failure(f"ERR usage: {USAGE[name][0]}")
        try:
            return run(args)
        except (StatusError, Refused) as e:
            return Failure(f"ERR {e}")

    def do_ping(self, args):
        return args[1] if len(args) > 1 else Simple("PONG")

    def do_echo(self, args):
        return args[1] if len(args) == 2 else Failure("ERR wrong number of arguments for 'echo' command")

    def do_quit(self, args):
        self.closed = True
        return Simple("OK")

    def do_hello(self, args):
        return ["server", self.server, "version", "0.1", "proto", "2", "id", "0", "mode", "standalone", "role", "master", "modules", []]

    def do_info(self, args):
        return f"# Server\nredis_version:0.1\nserver:{self.server}\nbind:{self.bind}\nport:{self.port}\ndb_path:{self.engine.store.path}\n"

    def do_command(self, args):
        return []

    def do_client(self, args):
        return Simple("OK")

    def do_vcreate(self, args):
        dimension = count(args[2], "dimension", 1)
        try:
            metric = text_metric(args[3])
        except StatusError:
            raise Refused("invalid metric") from None
        more = {k: count(v, k) for k, v in zip(("max_degree", "ef_construction"), args[4:], strict=False)}
        self.engine.create_index(args[1], IndexOptions(dimension, metric, **more))
        return Simple("OK")

    def do_vdrop(self, args):
        self.engine.drop_index(args[1])
        return Simple("OK")

    def do_vlist(self, args):
        return self.engine.list_indexes()

    def do_vhasindex(self, args):
        return int(self.engine.has_index(args[1]))

    def do_vput(self, args):
        self.engine.put(args[1], count(args[2], "id"), needed(text_vector(args[3]), "vector"), args[4] if len(args) == 5 else "")
        return Simple("OK")

    def do_vget(self, args):
        id_, vector, payload = self.engine.get(args[1], count(args[2], "id"))
        return [signed(id_), [float_text(x) for x in vector], payload]

    def do_vdel(self, args):
        self.engine.delete(args[1], count(args[2], "id"))
        return 1

    def do_vsearch(self, args):
        query, top_k = needed(text_vector(args[2]), "vector"), count(args[3], "top_k", 1)
        ef, payload = max(top_k, 50), False
        if len(args) > 4:
            payload = upper(args[4]) == "WITHPAYLOADS"
            ef = ef if payload else count(args[4], "ef_search")
        if len(args) > 5:
            if upper(args[5]) != "WITHPAYLOADS":
                raise Refused("expected WITHPAYLOADS")
            payload = True
        rows = self.engine.search(args[1], query, SearchOptions(top_k, ef, payload)).collect()  # top_k rows
        return [[r["id"], float_text(r["score"]), *([r["payload"]] if payload else [])] for r in rows]

    def do_vstats(self, args):
        return [str(x) for kv in self.engine.stats(args[1]).items() for x in kv]
