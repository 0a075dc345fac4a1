"""quantloom.plans"""
