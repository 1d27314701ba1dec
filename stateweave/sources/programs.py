"""Programs, bundles, adapters and fitted estimators in folders of any file system that Spark knows.

A folder holds JSON and a manifest with checksums; nothing in it runs code when it is read.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import tempfile
import uuid

import numpy as np
from pyspark.sql import SparkSession

from ..schema import ValidationError

FORMAT = "stateweave-2"


class _Folder:
    """Files of a folder through Hadoop's file systems (the default one where a path names none)."""

    def __init__(self, path: str):
        self.spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        self.jvm = self.spark.sparkContext._jvm
        self.at = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.setVerifyChecksum(False)  # the manifest has its own
        self.fs.setWriteChecksum(False)

    def child(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.at, name)

    def write(self, name: str, body: bytes) -> None:
        out = self.fs.create(self.child(name), True)
        try:
            out.write(bytearray(body))
        finally:
            out.close()

    def read(self, name: str) -> bytes:
        if not self.fs.exists(self.child(name)):
            return b""
        file = self.fs.open(self.child(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(file))
        finally:
            file.close()


def scratch_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where none is set in local mode, a temporary one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="stateweave-")
    return folder.rstrip("/")


def _kinds() -> dict[str, type]:
    from .. import models
    from ..models import base
    from ..plans import program

    return {c.__name__: c for c in (program.Program, program.Bundle, program.SharedProgram, program.Feature, base.Adapter, base.ResourcePlan)} | {n: getattr(models, n) for n in models.__all__}


def encode(x):
    """Plain JSON values for programs, adapters, estimators and what they hold."""
    if isinstance(x, np.ndarray):
        return {"__array": x.tolist()}
    if isinstance(x, np.generic):
        return x.item()
    if isinstance(x, tuple):
        return {"__tuple": [encode(v) for v in x]}
    if isinstance(x, list):
        return [encode(v) for v in x]
    if isinstance(x, dict):
        return {"__dict": [[encode(k), encode(v)] for k, v in x.items()]}
    if dataclasses.is_dataclass(x):
        return {"__kind": type(x).__name__, "fields": [[f.name, encode(getattr(x, f.name))] for f in dataclasses.fields(x)]}
    if type(x).__name__ in _kinds():
        return {"__estimator": type(x).__name__, "fields": [[k, encode(v)] for k, v in vars(x).items()]}
    if x is None or isinstance(x, (bool, int, float, str)):
        return x
    raise TypeError(f"can't store {type(x).__name__}")


def decode(x):
    """What :func:`encode` was given."""
    if isinstance(x, list):
        return [decode(v) for v in x]
    if not isinstance(x, dict):
        return x
    if "__array" in x:
        return np.array(x["__array"])
    if "__tuple" in x:
        return tuple(decode(v) for v in x["__tuple"])
    if "__dict" in x:
        return {decode(k): decode(v) for k, v in x["__dict"]}
    name = x.get("__kind") or x["__estimator"]
    if name not in _kinds():
        raise ValidationError(f"unknown kind {name!r}")
    fields = {k: decode(v) for k, v in x["fields"]}
    if "__kind" in x:
        return _kinds()[name](**fields)
    out = _kinds()[name](**fields.pop("params"))
    vars(out).update(fields)
    return out


def save(thing, path: str) -> None:
    """Writes a folder with a program, bundle, adapter or fitted estimator; it appears whole or not at all."""
    body = json.dumps(encode(thing), sort_keys=True).encode()
    part = _Folder(f"{path.rstrip('/')}-part-{uuid.uuid4().hex}")
    part.fs.mkdirs(part.at)
    part.write("program.json", body)
    manifest = {"format": FORMAT, "kind": type(thing).__name__, "files": {"program.json": {"sha256": hashlib.sha256(body).hexdigest(), "bytes": len(body)}}}
    part.write("manifest.json", json.dumps(manifest, sort_keys=True).encode())
    target = _Folder(path)
    if target.fs.exists(target.at):
        target.fs.delete(target.at, True)
    if not part.fs.rename(part.at, target.at):
        raise OSError(f"{path} could not be written")


def verify(path: str) -> dict:
    """Checks sizes and checksums of all files; raises if any differs or is missing."""
    folder = _Folder(path)
    manifest = json.loads(folder.read("manifest.json") or b"{}")
    if manifest.get("format") != FORMAT:
        raise ValidationError(f"unknown format {manifest.get('format')!r}")
    for name, want in manifest["files"].items():
        body = folder.read(name)
        if len(body) != want["bytes"] or hashlib.sha256(body).hexdigest() != want["sha256"]:
            raise ValidationError(f"{name} differs from the manifest")
    return manifest


def load(path: str):
    """What :func:`save` wrote, after :func:`verify`."""
    verify(path)
    return decode(json.loads(_Folder(path).read("program.json")))
