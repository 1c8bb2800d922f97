"""Veterinary laboratory reports as whole-table Spark jobs."""
