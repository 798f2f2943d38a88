"""What can go wrong, by name."""


class GraphError(Exception):
    """Any error of this package."""


class EmptyGraph(GraphError):
    """There is no node."""


class NodeNotFound(GraphError):
    """A node that has to exist doesn't."""


class NodeAlreadyExists(GraphError):
    """A key that has to be new isn't."""


class WalkNotFound(GraphError):
    """A walk id that has to exist doesn't."""


class EmptyWalk(GraphError):
    """A walk has at least one node."""


class InvalidWalkIndex(GraphError):
    """A cut beyond a walk's ends."""


class InvalidAlpha(GraphError):
    """Alpha lies strictly between 0 and 1."""


class InvalidWalksPerNode(GraphError):
    """There is at least one walk per node."""


class InvalidTopK(GraphError):
    """top_k is at least 1."""


class EmptyWalkStore(GraphError):
    """There are no visits to divide by."""


class NodeNotInWalk(GraphError):
    """A walk is to be cropped at a node that it doesn't visit."""


class MissingDelta(GraphError):
    """An update needs a delta."""
