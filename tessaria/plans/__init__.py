"""tessaria.plans"""
