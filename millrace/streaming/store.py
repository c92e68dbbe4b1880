"""The client's store as a fold of its event log: sessions with their messages, parts, todos, requests and states.

Events are rows (directory, seq, type, session, id, part, parent, archived, value). Those of one session are folded in
their order, with the state of that session alone; counts of a directory's sessions are a second fold over few events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.streaming.scans import scan

# What each event does to which kind of entry; entries of a list are told by their ids.
PUTS = {
    "message.updated": "message",
    "permission.asked": "permission",
    "question.asked": "question",
    "todo.updated": "todo",
    "session.diff": "session_diff",
    "session.status": "session_status",
}
DROPS = {"permission.replied": "permission", "question.replied": "question", "question.rejected": "question"}
WHOLE = ("todo", "session_diff", "session_status")  # one entry for each session
SESSION = ("session.created", "session.updated", "session.deleted")
COUNTED = {"server.instance.disposed": "refreshes", "lsp.updated": "lsp_loads"}


class SessionState:
    """The entries of one session."""

    def __init__(self):
        self.entries: dict[tuple, str | None] = {}

    def _drop_message(self, message) -> None:
        self.entries.pop(("message", message, None), None)
        for key in [k for k in self.entries if k[0] == "part" and k[1] == message]:
            del self.entries[key]

    def step(self, e: dict) -> list:
        kind, entry = e["type"], (e["id"], e["part"])
        if kind == "session.deleted" or kind == "session.updated" and e["archived"]:
            self.entries.clear()
        elif kind in SESSION:
            self.entries["session", None, None] = e["value"]
        elif kind in PUTS:
            of = PUTS[kind]
            self.entries[of, None if of in WHOLE else e["id"], None] = e["value"]
        elif kind in DROPS:
            self.entries.pop((DROPS[kind], e["id"], None), None)
        elif kind == "message.removed":
            self._drop_message(e["id"])
        elif kind == "message.part.updated":
            self.entries["part", *entry] = e["value"]
        elif kind == "message.part.removed":
            self.entries.pop(("part", *entry), None)
        elif kind == "message.part.delta" and ("part", *entry) in self.entries:
            self.entries["part", *entry] = (self.entries["part", *entry] or "") + (e["value"] or "")
        return []

    def end(self) -> list:
        return [(*key, value) for key, value in self.entries.items()]


class Directory:
    """What a directory counts: its root sessions (never below 0), asked refreshes, and its branch."""

    def __init__(self):
        self.known: set = set()
        self.total, self.counts, self.branch = 0, dict.fromkeys(COUNTED.values(), 0), None

    def step(self, e: dict) -> list:
        kind, root = e["type"], e["parent"] is None
        if kind in COUNTED:
            self.counts[COUNTED[kind]] += 1
        elif kind == "vcs.branch.updated":
            self.branch = e["value"]
        elif kind == "session.created":
            self.total += root and e["session"] not in self.known
            self.known.add(e["session"])
        elif kind == "session.deleted" or kind == "session.updated" and e["archived"]:
            self.known.discard(e["session"])
            self.total = max(0, self.total - 1) if root else self.total
        elif kind == "session.updated":
            self.known.add(e["session"])
        return []

    def end(self) -> list:
        return [(self.total, *self.counts.values(), self.branch)]


def entries(events: DataFrame) -> DataFrame:
    """(session, kind, id, part, value) of every entry that the log leaves."""
    own = events.where("session is not null").select("session", "seq", "type", "id", "part", "archived", "value")
    return scan(own, ["session"], ["seq"], "session long, kind string, id long, part long, value string", SessionState)


def directories(events: DataFrame) -> DataFrame:
    """(directory, session_total, refreshes, lsp_loads, branch)."""
    kinds = [*SESSION, *COUNTED, "vcs.branch.updated"]
    own = events.where(F.col("type").isin(kinds)).select("directory", "seq", "type", "session", "parent", "archived", "value")
    return scan(own, ["directory"], ["seq"], "directory long, session_total long, refreshes long, lsp_loads long, branch string", Directory)
