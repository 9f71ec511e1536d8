"""vellum.operators"""
