"""A PySpark engine that matches people to roles, and prepares training text."""

from fitspark.config import METHOD, ProfileError, Role, Signal, load_role, role_of, structural
from fitspark.operators.components import COMPONENTS, compute_components
from fitspark.operators.intrinsic import INTRINSIC_COLUMNS, candidates_of, extract_intrinsic
from fitspark.operators.score import score_candidates

__all__ = ["COMPONENTS", "INTRINSIC_COLUMNS", "METHOD", "ProfileError", "Role", "Signal", "candidates_of", "compute_components", "extract_intrinsic", "load_role", "role_of", "score_candidates", "structural"]
