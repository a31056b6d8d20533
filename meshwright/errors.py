"""What can go wrong, each with the fields that say where."""

from __future__ import annotations


class MeshError(Exception):
    """Base of all errors of this library; keyword arguments become fields."""

    says = "{}"

    def __init__(self, **fields: object) -> None:
        self.fields = fields
        self.__dict__.update(fields)
        super().__init__(self.says.format_map(_Shown(fields)))


class _Shown(dict):
    def __missing__(self, key: str) -> str:
        return "?"


def _kind(name: str, says: str, base: type = MeshError) -> type:
    return type(name, (base,), {"says": says, "__doc__": says, "__module__": __name__})


VertexOutOfBounds = _kind("VertexOutOfBounds", "vertex {vertex} is not below {vertex_count}")
VertexIndexTooWide = _kind("VertexIndexTooWide", "vertex {vertex} does not fit into 32 bits")
SelfLoop = _kind("SelfLoop", "an edge joins vertex {vertex} to itself")
InvalidEdgeWeight = _kind("InvalidEdgeWeight", "edge {u}-{v} has weight {weight}; weights are finite and positive")
InvalidOption = _kind("InvalidOption", "option {option}: {reason}")
DimensionMismatch = _kind("DimensionMismatch", "{what}: expected {expected} values, found {found}")
NonFiniteValue = _kind("NonFiniteValue", "value {index} is not finite")
IncompatibleRhs = _kind("IncompatibleRhs", "the right-hand side sums to {total} over component {component}; {allowed} is allowed")
NotSymmetric = _kind("NotSymmetric", "entries ({i},{j}) and ({j},{i}) differ")
NegativeDiagonal = _kind("NegativeDiagonal", "diagonal entry {i} is negative: {value}")
PositiveOffDiagonal = _kind("PositiveOffDiagonal", "entry ({i},{j}) is positive: {value}")
NotDominant = _kind("NotDominant", "row {i} is not diagonally dominant")
NonPositivePivot = _kind("NonPositivePivot", "pivot {index} is {value}")
PcgBreakdown = _kind("PcgBreakdown", "{quantity} is {value} in iteration {iteration}")
MaximumIterations = _kind("MaximumIterations", "no convergence in {iterations} iterations; residual {residual}")
ResidualVerificationFailed = _kind("ResidualVerificationFailed", "the residual {residual} of the given right-hand side is above {target}")
InvalidHierarchy = _kind("InvalidHierarchy", "{reason}")
MemoryBudgetExceeded = _kind("MemoryBudgetExceeded", "{needed} bytes are needed, {budget} are allowed")
Cancelled = _kind("Cancelled", "cancelled in {phase}")
InvalidPanel = _kind("InvalidPanel", "{reason}")
InvalidParent = _kind("InvalidParent", "parent {parent} of vertex {vertex} is out of range")
