"""The engine's exceptions: one base class, so callers can catch all of them."""


class GraphClusterError(Exception):
    """Base of every error the engine raises."""


class InvalidConfig(GraphClusterError):
    """A setting is out of range."""


class InvalidWeight(GraphClusterError):
    """A weight is not finite and above zero."""


class InvalidInput(GraphClusterError):
    """An argument of a query does not fit (duplicates, odd buffers, unknown names, bad scores)."""


class IndexFailure(GraphClusterError):
    """The operation does not fit the graph: self-loops, unknown or dead nodes, no data, too few nodes."""
