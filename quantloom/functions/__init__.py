"""quantloom.functions"""
