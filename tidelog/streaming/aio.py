"""Asynchronous facade: one worker thread runs all requests in order; snapshots are integers."""

from __future__ import annotations

import asyncio
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

from tidelog.model import Options, Status
from tidelog.operators.batch import WriteBatch
from tidelog.sources.store import KVStore


class AsyncStore:
    def __init__(self, pool: ThreadPoolExecutor, store: KVStore):
        self._pool, self._store, self._snapshots = pool, store, {}

    @classmethod
    async def open(cls, spark: SparkSession, path: str, options: Options | None = None) -> "AsyncStore":
        pool = ThreadPoolExecutor(1)
        return cls(pool, await asyncio.get_running_loop().run_in_executor(pool, KVStore.open, spark, path, options))

    async def _do(self, f, *args):
        return await asyncio.get_running_loop().run_in_executor(self._pool, f, *args)

    async def close(self) -> None:
        await self._do(self._store.close)
        self._pool.shutdown()

    async def put(self, key: bytes, value: bytes) -> None:
        await self._do(self._store.put, key, value)

    async def delete(self, key: bytes) -> None:
        await self._do(self._store.delete, key)

    async def write(self, batch: WriteBatch, flush: bool = False) -> None:
        await self._do(self._store.write, batch, flush)

    async def flush(self) -> None:
        await self._do(self._store.flush)

    async def get(self, key: bytes) -> bytes | None:
        return await self._do(self._store.get, key)

    async def get_at(self, snapshot: int, key: bytes) -> bytes | None:
        if snapshot not in self._snapshots:
            raise Status("AsyncError", f"no snapshot {snapshot}")
        return await self._do(self._store.get, key, self._snapshots[snapshot])

    async def get_snapshot(self) -> int:
        s = await self._do(self._store.snapshot)
        self._snapshots[s.handle] = s
        return s.handle

    async def drop_snapshot(self, snapshot: int) -> None:
        if snapshot not in self._snapshots:
            raise Status("AsyncError", f"no snapshot {snapshot}")
        self._snapshots.pop(snapshot).release()

    async def compact_range(self, lo: bytes | None = None, hi: bytes | None = None) -> None:
        await self._do(self._store.compact_range, lo, hi)
