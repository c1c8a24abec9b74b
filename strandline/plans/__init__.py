"""The registered queries; importing the package registers them all."""

from strandline.plans import catalogue, controls, ingestion, scaled, surface  # noqa: F401
