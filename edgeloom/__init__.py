"""edgeloom: graph analytics over edge tables, expressed as Spark DataFrame plans."""

from edgeloom.engine import GraphEngine
from edgeloom.operators.graph import Graph

__all__ = ["Graph", "GraphEngine"]
__version__ = "0.1.0"
