"""A store whose files are altered, lost or doubled raises an error when it is read."""

import os
import shutil
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from ticktide.llm import tokenstore

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("store")
    rows = [(i, " ".join(f"word{(i * k) % 97}" for k in range(3 * i % 600)), 1, b"x") for i in range(80)] + [(7, "again", 1, b"x"), (None, "no id", 1, b"x"), (5, None, 1, b"x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int, root binary")
    tokenstore.TokenStore.write(docs, PATH, f"{folder}/s")
    return folder / "s"


def files(folder, name):
    return sorted((p for p in Path(folder, name).glob("*.parquet") if pq.read_metadata(p).num_rows), key=lambda p: -pq.read_metadata(p).num_rows)


def rewrite(path, change):
    found = pq.read_table(path)
    pq.write_table(change(found), path)
    crc = path.with_name(f".{path.name}.crc")
    if crc.exists():
        os.remove(crc)


def flipped(column):
    def change(found):
        values = found.column(column).to_pylist()
        values[0] = bytes([values[0][0] ^ 1]) + values[0][1:]
        return found.set_column(found.column_names.index(column), found.schema.field(column), pa.array(values, found.schema.field(column).type))

    return change


def swapped(found):
    return found.set_column(found.column_names.index("doc_id"), "doc_id", found.column("doc_id").take(pa.array([1, 0, *range(2, len(found))])))


DAMAGE = {
    "altered part root": lambda f: rewrite(files(f, "manifest")[0], flipped("root")),
    "altered top": lambda f: rewrite(files(f, "top")[0], flipped("root")),
    "altered address": lambda f: rewrite(files(f, "recipes/kind=0")[0], flipped("root")),
    "altered recipe": lambda f: rewrite(files(f, "recipes/kind=0")[0], flipped("recipe")),
    "altered chunk": lambda f: rewrite(files(f, "staged/kind=0")[0], flipped("body")),
    "lost chunks": lambda f: os.remove(files(f, "staged/kind=0")[0]),
    "lost recipes": lambda f: os.remove(files(f, "recipes/kind=0")[0]),
    "doubled recipe": lambda f: rewrite(files(f, "recipes/kind=0")[0], lambda x: pa.concat_tables([x, x.slice(0, 1)])),
    "swapped documents": lambda f: rewrite(files(f, "recipes/kind=0")[0], swapped),
    "lost part of the manifest": lambda f: rewrite(files(f, "manifest")[0], lambda x: x.slice(1)),
}


@pytest.mark.parametrize("kind", [None, *DAMAGE])
def test_damage_is_seen(spark, made, tmp_path, kind):
    shutil.copytree(made, tmp_path / "s")
    store = tokenstore.TokenStore(spark, str(tmp_path / "s"))
    if kind is None:
        assert store.checksums().count() == store.read().count() == 83
        return
    DAMAGE[kind](tmp_path / "s")
    for read in (lambda: store.checksums().collect(), lambda: store.read().collect()):
        with pytest.raises(Exception, match="agree|gapless|root|digest|number of ids|length|missing"):
            read()
