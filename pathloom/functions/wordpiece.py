"""WordPiece tokenising (uncased), padding, attention-masked pooling, and the embedding-model plug-in."""

from __future__ import annotations

import platform
import unicodedata
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.hashing import features, sums, unit

SPECIAL = ("[PAD]", "[UNK]", "[CLS]", "[SEP]")
LONGEST, MIN_LENGTH, MAX_LENGTH = 100, 8, 512
#: CJK ideograph blocks; each character is a token of its own. Fixed values.
CJK = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))


def _alone(c: str) -> bool:
    code = ord(c)
    return unicodedata.category(c).startswith("P") or any(a <= code <= z for a, z in CJK)


def _space(c: str, kind: str) -> bool:
    """Separators that may break a line; tab and newline are control characters and gone before."""
    return kind in ("Zs", "Zl", "Zp") and c not in "\u00a0\u2007\u202f"


def basic_tokens(text: str | None) -> list[str]:
    """Lower-cased, accents and control characters (tab and newline too) dropped, cut at separators; punctuation and
    ideographs stand alone. Symbols such as + or $ are no punctuation."""
    out, word = [], []
    for c in unicodedata.normalize("NFD", (text or "").lower()):
        kind = unicodedata.category(c)
        if kind.startswith("M") or kind in ("Cc", "Cf"):
            continue
        space = _space(c, kind)
        if space or _alone(c):
            if word:
                out.append("".join(word))
                word = []
            if not space:
                out.append(c)
        else:
            word.append(c)
    return [*out, "".join(word)] if word else out


class WordPiece:
    """``encode(text)``: input ids, attention mask and type ids, cut to ``max_length`` with [CLS] and [SEP] inside."""

    def __init__(self, vocabulary: dict[str, int], max_length: int = 256):
        if not MIN_LENGTH <= max_length <= MAX_LENGTH:
            raise ValueError(f"max_length must be {MIN_LENGTH} to {MAX_LENGTH}")
        missing = [t for t in SPECIAL if t not in vocabulary]
        if missing:
            raise ValueError(f"vocabulary without {', '.join(missing)}")
        self.vocabulary, self.max_length = vocabulary, max_length

    def pieces(self, word: str) -> list[str]:
        """The longest known piece from the left, again and again; one unknown token if any part is unknown."""
        if len(word) > LONGEST:
            return ["[UNK]"]
        out, at = [], 0
        while at < len(word):
            for end in range(len(word), at, -1):
                piece = ("##" if at else "") + word[at:end]
                if piece in self.vocabulary:
                    out.append(piece)
                    at = end
                    break
            else:
                return ["[UNK]"]
        return out

    def encode(self, text: str | None) -> tuple[list[int], list[int], list[int]]:
        tokens = [p for w in basic_tokens(text) for p in self.pieces(w)][: self.max_length - 2]
        ids = [self.vocabulary[t] for t in ("[CLS]", *tokens, "[SEP]")]
        return ids, [1] * len(ids), [0] * len(ids)


def encoded(df: DataFrame, column: str, tokenizer: WordPiece) -> DataFrame:
    """``df`` with input_ids, attention_mask and token_type_ids; the vocabulary is broadcast once."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [shared.value.encode(t) for t in part[column]]
            yield part.assign(input_ids=[g[0] for g in got], attention_mask=[g[1] for g in got], token_type_ids=[g[2] for g in got])

    kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInPandas(run, f"{kinds}, input_ids array<long>, attention_mask array<long>, token_type_ids array<long>")


def padded(rows: list[list[int]], fill: int = 0) -> np.ndarray:
    """A matrix as wide as the longest row."""
    out = np.full((len(rows), max(map(len, rows), default=0)), fill, dtype=np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the unmasked positions of (batch, length, dim), scaled to length one."""
    m = mask[:, :, None].astype(float)
    mean = (hidden * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-9)
    return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)).astype(np.float32)


class EmbeddingModel(Protocol):
    name: str
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashModel:
    """Feature hashing as an embedding model."""

    def __init__(self, dimension: int = 256):
        self.name, self.dimension = f"feature-hash-{dimension}", dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.array([unit(sums(*features(t, ()), self.dimension)) for t in texts])


#: Model file for each machine, as platform.machine() names it; any other takes the first. Fixed values.
ONNX_FILES = {"x86_64": "model_quint8_avx2.onnx", "aarch64": "model_qint8_arm64.onnx", "arm64": "model_qint8_arm64.onnx"}


def model_path(folder: str, machine: str | None = None) -> str:
    """The model file in ``folder`` for this (or the named) machine."""
    name = ONNX_FILES.get((machine or platform.machine()).lower(), next(iter(ONNX_FILES.values())))
    return f"{folder.rstrip('/')}/{name}"


def file_sha256(spark, path: str) -> str:
    """The digest of one file, whatever the file system, in lower-case hex; read by a task, not by the driver."""
    rows = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("digest")).limit(2).collect()
    if len(rows) != 1:
        raise FileNotFoundError(path)
    return rows[0].digest


class OnnxModel:
    """A sentence encoder in ONNX, tokenised by WordPiece; a session opens once in each worker."""

    def __init__(self, path: str, tokenizer: WordPiece, dimension: int = 384, name: str = "onnx"):
        self.path, self.tokenizer, self.dimension, self.name, self._session = path, tokenizer, dimension, name, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_session": None}

    def embed(self, texts: list[str]) -> np.ndarray:
        import onnxruntime

        self._session = self._session or onnxruntime.InferenceSession(self.path, providers=["CPUExecutionProvider"])
        ids, mask, kinds = (padded(list(x)) for x in zip(*map(self.tokenizer.encode, texts), strict=True))
        wanted = {i.name for i in self._session.get_inputs()}
        feed = {k: v for k, v in {"input_ids": ids, "attention_mask": mask, "token_type_ids": kinds}.items() if k in wanted}
        return pooled(self._session.run(None, feed)[0], mask)


def embed_with(df: DataFrame, text: str, model: EmbeddingModel, batch: int = 16) -> DataFrame:
    """``df`` with column ``embedding`` from column ``text``, ``batch`` texts (1 to 128) at a time."""
    if not 1 <= batch <= 128:
        raise ValueError("batch must be 1 to 128")
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c != "embedding"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [t if isinstance(t, str) else "" for t in part[text]]
            vectors = [v for a in range(0, len(texts), batch) for v in shared.value.embed(texts[a : a + batch])]
            yield part[kept].assign(embedding=vectors)

    kinds = dict(df.dtypes)
    return df.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", embedding array<float>")
