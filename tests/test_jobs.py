"""Whole jobs: files to contexts, chat payloads to prompts."""

import datetime as dt
import json

from quillspan.functions import vectors as V
from quillspan.jobs import ingest, remember
from quillspan.sources import changes


def test_files_to_contexts(spark, tmp_path):
    store, none = str(tmp_path / "store"), spark.createDataFrame([], ingest.REGISTRY)
    hook = V.Hook("jobs", lambda: V.hash_embed, 2)
    files = [("cats.txt", "Cats\nCats purr and sleep. Cats hunt mice.\n" * 3), ("empty.md", ""), ("x.zip", "no")]
    dogs = [("dogs.txt", "Dogs bark at strangers. Dogs fetch sticks."), ("gbk.txt", None)]
    frame = lambda own: spark.createDataFrame([(n, bytearray((t or "").encode() if t is not None else "狗叫 dogs".encode("gbk"))) for n, t in own], "file_name string, content binary")
    registry, said = ingest.ingest(frame(files), store, none, "cats", "cats purr", "2024-01-01", hook, 5, 20)
    assert {r.file_name: (r.parser, r.ok) for r in said.collect()} == {"cats.txt": ("text", True), "empty.md": ("text", True), "x.zip": (None, False)}
    registry, _ = ingest.ingest(frame(dogs), store, registry, "dogs", "dogs bark", "2024-01-02", hook, 5, 20)
    assert {(r.table_id, r.dim) for r in registry.collect()} == {("cats", 256), ("dogs", 256)}
    asked = spark.createDataFrame([(1, "cats purr"), (2, "dogs bark"), (3, "nothing alike")], "query_id long, text string")
    got = {r.query_id: (r.table_id, r.context) for r in ingest.answer_contexts(asked, store, registry, 2, 0.5, hook).collect()}
    assert got[1][0] == "cats" and "purr" in got[1][1] and "《cats.txt》" in got[1][1] and "bark" not in got[1][1]
    assert got[2][0] == "dogs" and "bark" in got[2][1] and got[3] == (None, None)
    assert ingest.answer_contexts(asked, str(tmp_path / "none"), registry, 2, 0.5, hook).where("context is not null").count() == 0


def test_payloads_to_prompts(spark, tmp_path):
    path, t = str(tmp_path), dt.datetime(2024, 1, 1)
    payload = lambda s, q, a: json.dumps({"session_id": s, "message": {"user": q, "system": a}})
    batch = lambda own, at: spark.createDataFrame([(v, t + dt.timedelta(minutes=at + i), at + i) for i, v in enumerate(own)], "value string, ts timestamp, seq long")
    save = remember.save_payloads(path, compact_after=2)
    first = batch([payload("s1", "What is a cat?", "A pet."), payload("s2", "Say hello", "Hello!"), "junk", json.dumps({"session_id": "s3"})], 0)
    save(first, 0)
    save(first, 0)
    save(batch([payload("s1", "And a dog?", "Another pet.")], 10), 1)
    save(batch([payload("s1", "Thanks", "Welcome.")], 20), 2)
    sessions = {r.id: (r.brief, r.create_time) for r in changes.saved(spark, f"{path}/sessions", remember.SESSIONS).collect()}
    assert sessions == {"s1": ("What is a cat?", t), "s2": ("Say hello", t + dt.timedelta(minutes=1))}
    assert changes.saved(spark, f"{path}/messages", remember.MESSAGES).count() == 8
    asked = spark.createDataFrame([(1, "s1", "another pet"), (2, "s9", "zzz")], "query_id long, session_id string, text string")
    got = {r.query_id: r.prompt for r in remember.prompts(asked, path, 2, 1).collect()}
    assert got == {1: "system: Another pet.【user: And a dog?, system: Another pet.】", 2: got[2]} and got[2].endswith("【】")
