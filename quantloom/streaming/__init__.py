"""quantloom.streaming"""
