"""Agent memory on a store: tools that take and return text, and a codec of records.

A record's key sorts an agent's records from the newest to the oldest.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.keys import descending
from strata.operators.batch import WriteBatch
from strata.schema import InvalidArgument
from strata.sources.store import Store

RECORD = "memory_id string, agent int, created_at decimal(20,0), revision decimal(20,0), text string"
AGENTS = 64
MOST_LISTED = 10_000


@dataclass(frozen=True)
class Memory:
    memory_id: str
    agent: int
    created_at: int
    revision: int
    text: str

    def encode(self) -> bytes:
        return json.dumps(asdict(self)).encode()

    @classmethod
    def decode(cls, data: bytes) -> Memory:
        return cls(**json.loads(data))


def agent_prefix(agent: int) -> bytes:
    return b"agent/%04d/memory/" % agent


def record_key(record: int) -> bytes:
    return agent_prefix(record % AGENTS) + b"%020d" % descending(record)


class AgentMemory:
    """Remember, recall, list the latest of an agent."""

    def __init__(self, store: Store):
        self.store = store

    def remember(self, record: int, text: str, revision: int = 1, durable: bool = True) -> None:
        m = Memory(f"m{record}", record % AGENTS, record, revision, text)
        (self.store.put_durable if durable else self.store.put)(record_key(record), m.encode())

    def recall(self, record: int) -> Memory | None:
        v = self.store.get(record_key(record))
        return None if v is None else Memory.decode(v)

    def recent(self, agent: int, k: int = 10) -> DataFrame:
        """The latest k records, decoded."""
        rows = self.store.prefix_values(agent_prefix(agent), k)
        return rows.select("k", F.from_json(F.col("v").cast("string"), RECORD).alias("m")).select("k", "m.*")


def _bytes(text: str, what: str) -> bytes:
    if not isinstance(text, str):
        raise InvalidArgument(f"{what} is a string")
    return text.encode()


class Tools:
    """Six calls over text keys and values that return plain dictionaries."""

    def __init__(self, store: Store):
        self.store = store

    def memory_put(self, key: str, value: str) -> dict:
        self.store.put(_bytes(key, "key"), _bytes(value, "value"))
        return {"key": key, "stored": True}

    def memory_get(self, key: str) -> dict:
        v = self.store.get(_bytes(key, "key"))
        return {"key": key, "found": v is not None, "value": None if v is None else v.decode()}

    def memory_delete(self, key: str) -> dict:
        self.store.delete(_bytes(key, "key"))
        return {"key": key, "deleted": True}

    def memory_list(self, prefix: str = "", limit: int = 100) -> dict:
        if not 0 <= limit <= MOST_LISTED:
            raise InvalidArgument(f"limit is from 0 to {MOST_LISTED}")
        rows = self.store.prefix_values(_bytes(prefix, "prefix"), limit).collect() if limit else []
        return {"entries": [{"key": bytes(r["k"]).decode(), "value": bytes(r["v"]).decode()} for r in rows]}

    def memory_batch(self, operations: list[dict]) -> dict:
        """Items with op (put or delete), key and, for puts, value; all or none."""
        batch = WriteBatch()
        for x in operations:
            if x.get("op") == "put" and "value" in x:
                batch.put(_bytes(x["key"], "key"), _bytes(x["value"], "value"))
            elif x.get("op") == "delete" and "value" not in x:
                batch.delete(_bytes(x["key"], "key"))
            else:
                raise InvalidArgument("an operation is a put with key and value or a delete with a key")
        self.store.write(batch)
        return {"applied": len(batch)}

    def memory_sync(self) -> dict:
        self.store.sync()
        return {"synced": True, "last_seq": self.store.last_seq}
