"""What a worker keeps of a tokenizer's pieces is bounded, and the ids stay those of the library."""

import public_tokenizers
from tokenizers import Tokenizer

from flowloom.llm import packing, tokens


def test_packing_keeps_few_pieces(monkeypatch):
    monkeypatch.setattr(tokens, "_encoders", {})
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 50)
    monkeypatch.setattr(packing.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [" ".join(f"word{i} again{i % 7}" for i in range(k, k + 40)) for k in range(0, 400, 20)]
    batch = packing.pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    (found,) = packing._cut(path, tokens.SPACED, 1, 2048, True)(iter([batch]))
    library = Tokenizer.from_file(path)
    for ids, text in zip(found.column("ids").to_pylist(), texts, strict=True):
        want = [*library.encode(text, add_special_tokens=False).ids, 1]
        assert ids == b"".join(i.to_bytes(4, "little") for i in want)
    (kept,) = tokens._encoders.values()
    assert 0 < len(kept._new) + len(kept._old) <= 100
