"""quantloom.sources"""
