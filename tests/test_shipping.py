import base64
import subprocess
import sys

from pyspark import cloudpickle

from rasterloom.operators import components
from rasterloom.sources import chunkstore


def test_task_helpers_load_where_the_package_is_not_installed(tmp_path):
    data = base64.b64encode(cloudpickle.dumps((components._label_block, chunkstore.ChunkReader))).decode()
    code = (
        "import base64, numpy as np; from pyspark import cloudpickle\n"
        f"f, _ = cloudpickle.loads(base64.b64decode('{data}'))\n"
        "print(len(set(f(np.array([0, 0, 2]), np.array([0, 1, 0])).tolist())))"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "2", out.stderr[-500:]
