import pytest

from fieldloom import session


class Conf:
    def __init__(self, **values):
        self.values = {k.replace("__", "."): v for k, v in values.items()}

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


class Session:
    def __init__(self, **values):
        self.conf = Conf(**values)


def test_the_named_folder_is_used_and_none_is_made_up():
    assert session.scratch_dir(Session(spark__checkpoint__dir="hdfs://a/b")) == "hdfs://a/b"
    bare = Session(spark__sql__warehouse__dir="hdfs://w/")
    with pytest.raises(RuntimeError):
        session.scratch_dir(bare)
    session.ensure_scratch(bare)
    assert session.scratch_dir(bare) == "hdfs://w/_scratch"
    named = Session(spark__checkpoint__dir="hdfs://a/b", spark__sql__warehouse__dir="hdfs://w")
    session.ensure_scratch(named)
    assert session.SCRATCH not in named.conf.values


def test_rounds_take_turns(spark):
    import glob

    rounds = session.Rounds(spark, "turns")
    df = spark.range(3)
    for _ in range(5):
        df = rounds.keep(df.selectExpr("id + 1 as id"))
    assert sorted(r.id for r in df.collect()) == [5, 6, 7]
    assert len(glob.glob(rounds.base.removeprefix("file:") + "/*")) == 2


def test_discarded_tables_are_gone(spark):
    kept, gone = session.materialise(spark.range(3)), session.materialise(spark.range(4))
    session.discard(gone)
    assert kept.count() == 3
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        spark.read.parquet(gone._scratch_path).count()
