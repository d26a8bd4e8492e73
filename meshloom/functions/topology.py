"""Shapes of cells and the numbering of their faces and edges."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Topology:
    """Counts, and the cell-vertex slots of each face and edge. The order of slots is part of results."""

    name: str
    vertices: int
    faces: tuple[tuple[int, ...], ...]
    edges: tuple[tuple[int, int], ...]

    @property
    def cell_vertices(self) -> int:
        return self.vertices

    @property
    def cell_faces(self) -> int:
        return len(self.faces)

    @property
    def cell_edges(self) -> int:
        return len(self.edges)

    @property
    def face_vertices(self) -> int:
        return len(self.faces[0])

    @property
    def face_edges(self) -> int:
        """As many as vertices: the boundary of a face is a cycle."""
        return len(self.faces[0])

    @property
    def edge_faces(self) -> tuple[tuple[int, ...], ...]:
        """For each edge slot the face slots, ascending, that hold both of its vertices."""
        return tuple(tuple(f for f, own in enumerate(self.faces) if set(e) <= set(own)) for e in self.edges)


# The slots of a tetrahedron. The order of a face's vertices carries its orientation.
TETRAHEDRON = Topology(
    "tetrahedron",
    4,
    ((1, 0, 2), (0, 1, 3), (1, 2, 3), (2, 0, 3)),
    ((0, 1), (1, 2), (2, 0), (0, 3), (1, 3), (2, 3)),
)
#: A hexahedron with vertices x + 2y + 4z, faces outward, edges by axis.
HEXAHEDRON = Topology(
    "hexahedron",
    8,
    ((0, 4, 6, 2), (1, 3, 7, 5), (0, 1, 5, 4), (2, 6, 7, 3), (0, 2, 3, 1), (4, 5, 7, 6)),
    tuple((a, a | bit) for bit in (1, 2, 4) for a in range(8) if not a & bit),
)
