"""Names of the queries registered in given modules: python tests/names.py reporting ingesting"""
import sys

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from jointwork.plans import catalog  # noqa: E402

print(" ".join(k for k, f in catalog.QUERIES.items() if f.__closure__[0].cell_contents.__module__.split(".")[-1] in sys.argv[1:]))
