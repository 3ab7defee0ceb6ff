import pytest

from tidemill import session


class Context:
    def __init__(self, given, master):
        self.given, self.master, self.applicationId = given, master, "app"

    def getCheckpointDir(self):
        return self.given


class Session:
    def __init__(self, named=None, given=None, master="local[2]"):
        self.sparkContext, self.conf = Context(given, master), {"spark.checkpoint.dir": named} if named else {}


def test_named_and_given_folders():
    assert session.shared_dir(Session("file:///a/b/", "file:/a/b/5f")) == "file:///a/b"
    assert session.shared_dir(Session("hdfs://n/a", None)) == "hdfs://n/a"
    assert session.shared_dir(Session("file:///a/b", "file:/elsewhere/5f")) == "file:/elsewhere/5f"
    assert session.shared_dir(Session(None, "file:/c/5f")) == "file:/c/5f"


def test_no_folder_of_one_machine_on_a_cluster():
    assert session.shared_dir(Session()).startswith("file:///")
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            session.shared_dir(Session(master=master))
