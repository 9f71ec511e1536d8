"""vellum.streaming"""
