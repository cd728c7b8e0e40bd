"""Operators of vectors and matrices, which make the expressions of tessera.plans.expressions."""

from __future__ import annotations


def _sum(x):
    from tessera.plans.expressions import as_sum

    return as_sum(x)


def _matrices(a):
    from tessera.plans.expressions import as_matrix_sum

    return as_matrix_sum(a)


class VectorNotation:
    """The operators of Vector: each gives terms, or a vector where values are needed."""

    def __add__(self, other):
        return _sum(self) + other

    def __sub__(self, other):
        return _sum(self) - other

    def __mul__(self, other):
        return _sum(self) * other

    def __truediv__(self, other):
        return _sum(self) / other

    def __neg__(self):
        return -_sum(self)

    __radd__ = __add__
    __rmul__ = __mul__

    def __rsub__(self, other):
        return (-_sum(self)) + other

    def __rtruediv__(self, other):
        return other / _sum(self)

    def __pow__(self, s: float):
        return self.scalar("pow", s)

    def __abs__(self):
        return self.unary("abs")


class MatrixNotation:
    """The operators of Matrix: each gives terms."""

    def __add__(self, other):
        return _matrices(self) + other

    def __sub__(self, other):
        return _matrices(self) - other

    def __mul__(self, s: float):
        return _matrices(self) * s

    __rmul__ = __mul__

    def __truediv__(self, s: float):
        return _matrices(self) / s

    def __neg__(self):
        return -_matrices(self)

    def __matmul__(self, other):
        return _matrices(self) @ other
