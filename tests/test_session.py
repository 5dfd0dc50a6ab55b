from __future__ import annotations

import pytest

from evidra import session


class Context:
    master = "spark://head:7077"

    def getCheckpointDir(self):
        return None


class Conf:
    def get(self, name, default):
        return default


class Session:
    sparkContext, conf = Context(), Conf()


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_parts():
    assert session.in_parts(0, 10) == 1 and session.in_parts(95, 10) == 10 and session.in_parts(10**12, 10) == session.MOST_PARTS
